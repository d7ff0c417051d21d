"""Run histories, run-log text, fitted models and trial tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.columns import as_column, duration_seconds, duration_text
from caseloom.sources.versions import KeyedAppends, current, publish

# The line shapes of a run log.
EPOCH_LINE = r"^Epoch (\d+)/(\d+), Train Loss: (\S+), Time: ([^,]+), Total Time: (.+)$"
CHECK_LINE = r"^Epoch (\d+), Val Loss: (\S+), Val Time: ([^,]+?)(?:, BERTScore F1: (\S+))?$"
FINAL_LINE = r"^Final Test Loss: ([^\s,]+)(?:, BERTScore P: ([^\s,]+), R: ([^\s,]+), F1: (\S+))?$"


def append_history(df: DataFrame, path: str, keys: Sequence[str] = ("run_id", "epoch"), attempt: str | None = None) -> None:
    """Add rows to a stored history; the same rows again count once. Run ids are data, so any text keeps its form."""
    KeyedAppends(df.sparkSession, path, keys, attempt).append(df)


def read_history(
    spark: SparkSession,
    path: str,
    runs: Sequence[str] | None = None,
    run: str = "run_id",
    keys: Sequence[str] = ("run_id", "epoch"),
    attempt: str | None = None,
) -> DataFrame:
    """A stored history, or some of its runs: the last row of each key."""
    history = KeyedAppends(spark, path, keys, attempt).read()
    return history if runs is None else history.where(F.col(run).isin(list(runs)))


def compact_history(spark: SparkSession, path: str, keys: Sequence[str] = ("run_id", "epoch"), attempt: str | None = None) -> None:
    """Make one folder of all complete appends, while others may append."""
    KeyedAppends(spark, path, keys, attempt).compact()


def _four(c: Column | str) -> Column:
    return F.format_string("%.4f", as_column(c).cast("double"))


def epoch_line(epoch, epochs, train_loss, seconds, total_seconds) -> Column:
    return F.concat(
        F.lit("Epoch "), as_column(epoch), F.lit("/"), as_column(epochs),
        F.lit(", Train Loss: "), _four(train_loss),
        F.lit(", Time: "), duration_text(seconds),
        F.lit(", Total Time: "), duration_text(total_seconds),
    )


def check_line(epoch, val_loss, seconds, f1=None) -> Column:
    line = F.concat(
        F.lit("Epoch "), as_column(epoch),
        F.lit(", Val Loss: "), _four(val_loss),
        F.lit(", Val Time: "), duration_text(seconds),
    )
    if f1 is None:
        return line
    return F.concat(line, F.coalesce(F.concat(F.lit(", BERTScore F1: "), _four(f1)), F.lit("")))


def final_line(test_loss, precision=None, recall=None, f1=None) -> Column:
    line = F.concat(F.lit("Final Test Loss: "), _four(test_loss))
    if precision is None:
        return line
    scores = F.concat(
        F.lit(", BERTScore P: "), _four(precision), F.lit(", R: "), _four(recall), F.lit(", F1: "), _four(f1)
    )
    return F.concat(line, F.coalesce(scores, F.lit("")))


def parse_log(df: DataFrame, line: str = "value") -> DataFrame:
    """Columns out of log lines; a line of no known shape has kind ``other``."""
    text = F.col(line)
    # each shape's groups, in the order the pattern has them
    shapes = {
        "epoch": (EPOCH_LINE, ("epoch", "epochs", "loss", "seconds", "total_seconds")),
        "check": (CHECK_LINE, ("epoch", "loss", "seconds", "f1")),
        "final": (FINAL_LINE, ("loss", "precision", "recall", "f1")),
    }
    kind, groups = F.lit("other"), F.lit(None).cast("array<string>")
    for shape, (pattern, names) in shapes.items():
        kind = F.when(text.rlike(pattern), shape).otherwise(kind)
        marked = F.regexp_replace(text, pattern, "\x01".join(f"${n}" for n in range(1, len(names) + 1)))
        groups = F.when(F.col("kind") == shape, F.split(marked, "\x01")).otherwise(groups)

    def found(name: str) -> Column:
        value = F.lit(None).cast("string")
        for shape, (_, names) in shapes.items():
            if name in names:
                value = F.when(F.col("kind") == shape, F.col("__groups")[names.index(name)]).otherwise(value)
        return F.nullif(value, F.lit(""))

    whole, durations = ("epoch", "epochs"), ("seconds", "total_seconds")
    numbers = ("loss", "precision", "recall", "f1")
    split = df.withColumn("kind", kind).withColumn("__groups", groups)
    texts = split.select(*df.columns, "kind", *[found(c).alias(c) for c in (*whole, *durations, *numbers)])
    return texts.select(
        *df.columns,
        "kind",
        *[F.col(c).try_cast("int").alias(c) for c in whole],
        F.col("loss").try_cast("double").alias("loss"),
        *[duration_seconds(c).alias(c) for c in durations],
        *[F.col(c).try_cast("double").alias(c) for c in numbers if c != "loss"],
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path))


def save_best(model: PipelineModel, folder: str, keep: int = 3) -> str:
    """Store the best model as a new version; the former one stays until this is complete."""
    return publish(f"{folder}/best_model", lambda path: model.write().save(path), keep)


def load_best(folder: str) -> PipelineModel:
    return PipelineModel.load(current(f"{folder}/best_model"))


def save_epoch(model: PipelineModel, folder: str, epoch: int) -> str:
    """Store a periodic model under its epoch, as a new version."""
    return publish(f"{folder}/checkpoint_epoch_{epoch}", lambda path: model.write().save(path), 1)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_trials(trials: DataFrame, best: DataFrame, folder: str, keep: int = 3) -> str:
    """All trials as Parquet and the best parameters as JSON, together as one version."""

    def write(path: str) -> None:
        trials.write.parquet(f"{path}/trials")
        best.write.json(f"{path}/best")

    return publish(folder, write, keep)


def read_trials(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The current trials and best parameters."""
    path = current(folder)
    return spark.read.parquet(f"{path}/trials"), spark.read.json(f"{path}/best")
