"""Hyper-parameter trials as tables: sampling, best trial, pruning and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions.columns import unit_interval
from caseloom.operators.scan import Running, global_index, running, step_segment, with_value_segments

# The default search space.
SEARCH_SPACE = {
    "learning_rate": ("log_uniform", 1e-6, 1e-4),
    "batch_size": ("choice", 8, 16, 32),
    "lora_rank": ("integer", 4, 16),
    "lora_alpha": ("integer", 16, 64),
    "lora_dropout": ("uniform", 0.0, 0.5),
    "gen_weight": ("uniform", 0.1, 0.9),
}
# Parameters that are one minus another.
COMPLEMENTS = {"cls_weight": "gen_weight"}


def sampled(trial: Column | str, name: str, rule: Sequence, seed: int) -> Column:
    """One parameter of a trial, drawn repeatably from its rule."""
    kind, *values = rule
    u = unit_interval(trial, F.lit(name), seed=seed)
    if kind == "choice":
        index = F.floor(u * len(values)).cast("int")
        return F.get(F.array(*[F.lit(v) for v in values]), index)
    low, high = values
    if kind == "log_uniform":
        return F.exp(F.log(F.lit(low)) + u * (F.log(F.lit(high)) - F.log(F.lit(low))))
    if kind == "uniform":
        return F.lit(low) + u * F.lit(high - low)
    if kind == "integer":
        return (F.lit(low) + F.floor(u * (high - low + 1))).cast("int")
    raise ValueError(f"unknown rule: {kind}")


def sample_space(
    trials: DataFrame,
    trial: str = "trial",
    space: Mapping[str, Sequence] = SEARCH_SPACE,
    complements: Mapping[str, str] = COMPLEMENTS,
    seed: int = 42,
) -> DataFrame:
    """Add drawn parameters to a table of trial numbers."""
    drawn = trials.withColumns({name: sampled(trial, name, rule, seed) for name, rule in space.items()})
    return drawn.withColumns({new: F.lit(1.0) - F.col(old) for new, old in complements.items() if old in space})


def best_trial(trials: DataFrame, value: str = "value", trial: str = "trial") -> DataFrame:
    """The trial with the lowest objective, the earliest one on ties."""
    return trials.where(F.col(value).isNotNull()).orderBy(value, trial).limit(1)


def trial_history(trials: DataFrame, value: str = "value", trial: str = "trial") -> DataFrame:
    """Objective and best objective so far, along the trials.

    Trial ids may be numbers or text; text goes by its spelling.
    """
    best = [Running("best_value", "min", F.col(value))]
    if isinstance(trials.schema[trial].dataType, T.NumericType):
        return running(with_value_segments(trials, trial), [], [trial], best)
    placed = global_index(trials, [F.col(trial)], "__place")
    return running(placed, [], ["__place"], best, step_segment("__place")).drop("__place")


def param_slice(trials: DataFrame, params: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long form: one row per trial and parameter."""
    numbers = trials.select(*keep, *[F.col(p).cast("double").alias(p) for p in params])
    return numbers.unpivot(list(keep), list(params), "param", "param_value")


def _with_ranges(trials: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add the minimum and maximum of each column, found by one scalar subquery."""
    bounds = [
        F.struct(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c)
        for c in columns
    ]
    return trials.withColumn("__ranges", trials.agg(F.struct(*bounds).alias("ranges")).scalar())


def _scaled(column: str) -> Column:
    bounds, value = F.col("__ranges")[column], F.col(column)
    width = bounds["high"] - bounds["low"]
    return F.when(value.isNotNull(), F.when(width > 0, (value - bounds["low"]) / width).otherwise(0.0))


def param_scaled(trials: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled to [0, 1] over the whole table; a constant one becomes 0."""
    return _with_ranges(trials, columns).withColumns({c: _scaled(c) for c in columns}).drop("__ranges")


def param_importance(trials: DataFrame, params: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """Share of the objective's variance that lies between equal-width parameter bins.

    A simple measure: it ranks parameters one at a time, without interactions.
    """
    known = _with_ranges(trials, params).where(F.col(value).isNotNull())
    binned = known.select(
        F.col(value).cast("double").alias("y"),
        *[F.least(F.floor(_scaled(p) * bins), F.lit(bins - 1)).alias(p) for p in params],
    ).unpivot(["y"], list(params), "param", "bin")
    per_bin = (
        binned.where(F.col("bin").isNotNull())
        .groupBy("param", "bin")
        .agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("var"))
    )
    # at most `bins` rows per parameter from here on
    whole = Window.partitionBy("param")
    grand = F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    parts = per_bin.withColumn("apart", F.pow(F.col("mean") - grand, F.lit(2.0)))
    between = F.sum(F.col("n") * F.col("apart"))
    within = F.sum(F.col("n") * F.col("var"))
    return parts.groupBy("param").agg(
        F.when(between + within > 0, between / (between + within)).otherwise(0.0).alias("importance")
    )
