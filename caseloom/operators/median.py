"""Median pruning of trials, with an exact running median that stays parallel."""

from __future__ import annotations

import math
from bisect import insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.scan import Running, position, running, step_segment, with_value_segments
from caseloom.session import stored

# Shortest block worth a task's attention.
BLOCK_ROWS = 1024
# Trial blocks served by one copy of a value block.
WANTED = 16


def _block_medians(centre: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """Median of all earlier values, for the rows of one block in trial order.

    ``centre`` holds the values around the middle of everything before the
    block. A block moves the middle by at most its own length, so values further
    out only matter by their number, which is ``below``.
    """
    block = block.sort_values("x")
    values = sorted(centre["v"])
    below = int(centre["below"].min()) if len(centre) else 0
    medians = []
    for x, value in zip(block["x"], block["value"]):
        seen = x - 1
        if seen:
            low, high = (seen - 1) // 2 - below, seen // 2 - below
            medians.append((values[low] + values[high]) / 2)
        else:
            medians.append(None)
        insort(values, value)
    return block.assign(median=medians)[["step", "trial", "value", "best", "x", "median"]]


def running_median(steps: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Add ``earlier`` and the ``median`` of the values of earlier trials at the same step.

    ``steps`` has step, trial, value and best. Each step's trials are cut into
    blocks by trial order and by value order; counts per cell of that grid tell
    which few value blocks hold the middle values before a trial block. With
    blocks of at least the square root of the longest step, the grid has no more
    cells than the table has rows, and no task holds more than a few blocks.
    """
    steps = stored(steps)
    by_trial = running(with_value_segments(steps, "trial", "step"), ["step"], ["trial"], [position("x")])
    by_trial = stored(by_trial)
    cut = with_value_segments(by_trial, "value", "trial")
    placed = stored(running(cut, ["step"], ["value", "trial"], [position("y")]))
    if block_rows is None:
        longest = placed.agg(F.max("x")).first()[0] or 1
        block_rows = max(math.isqrt(longest), BLOCK_ROWS)
    size = F.lit(block_rows)
    placed = placed.withColumns({"xb": F.floor((F.col("x") - 1) / size), "yb": F.floor((F.col("y") - 1) / size)})

    cells = placed.groupBy("step", "xb", "yb").agg(F.count("*").alias("n"))
    extent = placed.groupBy("step").agg(F.max("xb").alias("last"))
    grid = extent.select("step", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("yb"))
    grid = grid.select("step", "yb", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("xb"))
    earlier = (Window.unboundedPreceding, -1)
    along_trials = Window.partitionBy("step", "yb").orderBy("xb").rowsBetween(*earlier)
    along_values = Window.partitionBy("step", "xb").orderBy("yb").rowsBetween(*earlier)
    counted = (
        grid.join(cells, ["step", "xb", "yb"], "left")
        .select("step", "xb", "yb", F.coalesce(F.sum("n").over(along_trials), F.lit(0)).alias("here"))
        .withColumn("below", F.coalesce(F.sum("here").over(along_values), F.lit(0)))
    )
    before = F.col("xb") * size  # rows ahead of the block
    near = (F.col("below") < F.floor(before / 2) + size + 2) & (
        F.col("below") + F.col("here") > F.floor(before / 2) - size - 2
    )
    wanted = counted.where((F.col("here") > 0) & near).select("step", "yb", F.col("xb").alias("block"), "below")
    # a value block near the middle is wanted by most trial blocks: it is repeated for
    # every WANTED of them, so that no key gives more than that many times its rows
    copies = wanted.groupBy("step", "yb").agg(F.ceil(F.count("*") / WANTED).alias("copies"))
    wanted = wanted.join(copies, ["step", "yb"]).withColumn("copy", F.col("block") % F.col("copies")).drop("copies")
    values = placed.select("step", "yb", "xb", F.col("value").alias("v")).join(copies, ["step", "yb"])
    values = values.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    centre = (
        values.join(wanted, ["step", "yb", "copy"])
        .where(F.col("xb") < F.col("block"))
        .select("step", F.col("block").alias("xb"), "v", "below")
    )
    schema = "step long, trial long, value double, best double, x long, median double"
    blocks = placed.select(
        F.col("step").cast("long"), F.col("trial").cast("long"), "value", "best", "x", "xb"
    )
    done = (
        centre.withColumn("step", F.col("step").cast("long"))
        .groupBy("step", "xb")
        .cogroup(blocks.groupBy("step", "xb"))
        .applyInPandas(_block_medians, schema)
    )
    return done.select("trial", "step", "value", "best", (F.col("x") - 1).alias("earlier"), "median")


def median_prune(
    steps: DataFrame, n_warmup_steps: int = 5, n_startup_trials: int = 5, block_rows: int | None = None
) -> DataFrame:
    """Mark the steps at which a trial would be pruned (smaller values are better).

    ``steps`` has trial, step (from 0) and value. A trial is pruned when its best
    value so far is worse than the median of the earlier trials at that step,
    once enough steps and enough earlier trials have passed. A null or NaN value is
    no earlier value for others; its own row stays, without a median and unpruned.
    """
    number = F.col("value").isNotNull() & ~F.isnan("value")
    known = steps.where(number).select("trial", "step", "value")
    best = running(known, ["trial"], ["step"], [Running("best", "min", F.col("value"))], step_segment("step"))
    scanned = running_median(best, block_rows)
    worse = (F.col("step") >= n_warmup_steps) & (F.col("earlier") >= n_startup_trials)
    judged = scanned.withColumn("prune", worse & (F.col("best") > F.col("median")))
    other = steps.where(~number).select("trial", "step", "value").withColumn("prune", F.lit(False))
    return judged.unionByName(other, allowMissingColumns=True)
