"""One summary of losses, class metrics and text metrics."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from caseloom.operators.classes import class_metrics, roc_auc
from caseloom.operators.runs import epoch_loss
from caseloom.operators.texts import both_present, mean_scores, meteor, nonblank_pairs, rejected_count


def _long(row: DataFrame) -> DataFrame:
    """A one-row table as (metric, value) rows."""
    return row.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])
        ).alias("m")
    ).select("m.*")


@contextmanager
def _session_apart(rows: DataFrame) -> Iterator[DataFrame]:
    """The same rows in a session of their own, with the same settings.

    A session that has observed anything cannot run Spark ML fits any more (Spark 4.1 then
    fails to serialise it), so observations are kept out of the caller's session.
    """
    spark, name = rows.sparkSession, f"rows_{uuid.uuid4().hex}"
    rows.createGlobalTempView(name)
    try:
        other = spark.newSession()
        for key, value in spark.conf.getAll.items():
            if spark.conf.isModifiable(key):
                other.conf.set(key, value)
        yield other.table(f"global_temp.{name}")
    finally:
        spark.catalog.dropGlobalTempView(name)


def evaluate_while_writing(
    rows: DataFrame,
    folder: str,
    loss: str = "loss",
    truth: str = "y",
    decision: str = "p",
    prediction: str = "prediction",
    reference: str = "reference",
    required: Sequence[str] = (),
) -> DataFrame:
    """Write predictions as Parquet and return their summary (metric, value), from one pass.

    Spark observes the rows on their way to the files: mean loss (a missing one counts as
    0), confusion and the metrics of it, rejected text pairs, the number of rows, and for
    each ``required`` column how many values are missing. As ``evaluate`` has them; what
    needs an order or an exchange of rows (ROC AUC, METEOR) is not among them. Without
    rows the ratios are null. Only columns that the table has are judged.
    """
    here = {*rows.columns}
    col = lambda name: F.col(f"`{name}`")
    sums: dict[str, Column] = {"rows": F.count(F.lit(1))}
    if loss in here:
        sums["loss_sum"] = F.sum(F.coalesce(col(loss), F.lit(0.0)))
    if {truth, decision} <= here:
        for name, y, p in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0)):
            sums[name] = F.count_if((col(truth) == y) & (col(decision) == p))
    if {prediction, reference} <= here:
        sums["rejected"] = F.count_if(~both_present(f"`{prediction}`", f"`{reference}`"))
    for i, name in enumerate(required):
        sums[f"missing_{i}"] = F.count_if(col(name).isNull()) if name in here else F.count(F.lit(1))
    with _session_apart(rows) as apart:
        seen = Observation(f"evaluation-{uuid.uuid4().hex}")
        apart.observe(seen, *(c.alias(n) for n, c in sums.items())).write.parquet(folder)
        got = {name: value or 0 for name, value in seen.get.items()}

    def ratio(top: float, bottom: float) -> float | None:
        return top / bottom if bottom else None

    found: dict[str, float | None] = {"rows": got["rows"]}
    if "loss_sum" in got:
        found["loss"] = ratio(got["loss_sum"], got["rows"])
    if "tp" in got:
        tp, fp, tn, fn = (got[c] for c in ("tp", "fp", "tn", "fn"))
        found |= {
            "accuracy": ratio(tp + tn, tp + fp + tn + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn) or 0.0,
            "sensitivity": ratio(tp, tp + fn),
            "specificity": ratio(tn, tn + fp),
        }
    if "rejected" in got:
        found["rejected"] = got["rejected"]
    found |= {f"missing_{name}": got[f"missing_{i}"] for i, name in enumerate(required)}
    summary = [(name, None if value is None else float(value)) for name, value in found.items()]
    return rows.sparkSession.createDataFrame(summary, "metric string, value double")


def evaluate(
    batches: DataFrame | None = None,
    classes: DataFrame | None = None,
    pairs: DataFrame | None = None,
    token_scores: DataFrame | None = None,
) -> DataFrame:
    """Long summary (metric, value) of whichever result tables are passed.

    ``batches`` (loss), ``classes`` (y, p, score), ``pairs`` (row_id, prediction,
    reference), ``token_scores`` (precision, recall, f1 per pair).
    """
    parts = []
    if batches is not None:
        parts.append(epoch_loss(batches, by=()).select(F.col("mean_loss").alias("loss")))
    if classes is not None:
        parts += [class_metrics(classes, "y", "p"), roc_auc(classes, "y", "score")]
    if pairs is not None:
        parts += [mean_scores(meteor(nonblank_pairs(pairs)), "meteor"), rejected_count(pairs)]
    if token_scores is not None:
        match = mean_scores(token_scores, "precision", "recall", "f1")
        parts.append(match.select(*[F.col(c).alias(f"match_{c}") for c in match.columns]))
    return reduce(DataFrame.unionByName, [_long(p) for p in parts])
