"""Ordered computations that stay parallel when one group holds most rows.

A plain ``Window.partitionBy(run).orderBy(step)`` puts a whole run into one task.
Here each run is cut into segments along its order. A window works inside every
segment, one small aggregate per segment is carried over to the later segments
of the same run, and the two are combined. No task sees more than one segment.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.session import stored

SEGMENT = "__segment"
SEGMENT_ROWS = 1 << 16

_FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``fold`` of ``value`` up to the current row.

    ``through=False`` leaves the current row itself out.
    """

    name: str
    fold: str
    value: Column
    through: bool = True


def position(name: str = "position") -> Running:
    """Exact 1-based row number along the order."""
    return Running(name, "sum", F.lit(1).cast("bigint"))


def _combine(fold: str, here: Column, carried: Column) -> Column:
    if fold == "sum":
        return F.coalesce(here + carried, here, carried)
    return F.least(here, carried) if fold == "min" else F.greatest(here, carried)


def step_segment(step: str, rows: int = SEGMENT_ROWS) -> Column:
    """Segments for a whole-number step, unique in its run: at most ``rows`` each."""
    return F.floor(F.col(step) / rows)


def with_value_segments(df: DataFrame, *order: str, segments: int | None = None) -> DataFrame:
    """Add a segment number that grows along ``order`` and holds a bounded row share; stored.

    One range exchange deals the rows, and the number of the partition is the segment, so
    neither cut points nor counts reach the driver. Name as many columns as make rows
    different: rows equal in all of them stay together. Without ``segments`` Spark
    chooses the number. The table is stored once, because sampled ranges may differ when
    they are worked out again, and everything along the order reads it twice.
    """
    dealt = df.repartitionByRange(segments, *order) if segments else df.repartitionByRange(*order)
    return stored(dealt.withColumn(SEGMENT, F.spark_partition_id().cast("bigint")), "segments")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggregates: Sequence[Running],
    segment: Column | None = None,
) -> DataFrame:
    """Add running aggregates per ``keys`` along ``order``.

    ``segment`` must not fall as ``order`` rises; without it the table already
    carries one from :func:`with_value_segments`. Keys must not be null.
    """
    cut = df if segment is None else df.withColumn(SEGMENT, segment)
    within = Window.partitionBy(*keys, SEGMENT).orderBy(*order)
    frames = {
        True: within.rowsBetween(Window.unboundedPreceding, 0),
        False: within.rowsBetween(Window.unboundedPreceding, -1),
    }
    local = cut.select(
        "*", *[_FOLDS[a.fold](a.value).over(frames[a.through]).alias(a.name) for a in aggregates]
    )
    totals = cut.groupBy(*keys, SEGMENT).agg(
        *[_FOLDS[a.fold](a.value).alias(f"__{a.name}") for a in aggregates]
    )
    earlier = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, SEGMENT, *[_FOLDS[a.fold](f"__{a.name}").over(earlier).alias(f"__{a.name}") for a in aggregates]
    )
    joined = local.join(carried, [*keys, SEGMENT], "left")
    names = {a.name for a in aggregates}
    return joined.select(
        *[c for c in df.columns if c not in names and c != SEGMENT],
        *[_combine(a.fold, F.col(a.name), F.col(f"__{a.name}")).alias(a.name) for a in aggregates],
    )


def global_index(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Exact 1-based index of every row along any (also composite or text) order.

    One range shuffle sorts the table; the sorted table is stored once, and the
    sizes of its partitions, one row each, turn local into global positions.
    """
    at = "__at"
    placed = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    )
    part = F.shiftright(at, 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__start"))
    inside = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition of the table: bounded by the partition count
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")
        .withColumn(name, F.col("__start") + inside + 1)
        .drop("__part", "__start", at)
    )
