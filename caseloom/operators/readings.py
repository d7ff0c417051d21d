"""Wide reading tables in long form, and left/right differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators.regression import KINDS, POSITIONS, reading_columns


def readings_long(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per reading present: side, position, kind and temperature."""
    columns = reading_columns(df.columns)
    long = df.select(*keep, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot(
        list(keep), [F.col(f"`{c}`") for c in columns], "reading", "temp"
    )
    name = F.split("reading", " ")
    return long.select(
        *keep,
        F.substring(name[0], 1, 1).alias("side"),
        F.substring(name[0], 2, 2).cast("int").alias("pos"),
        name[1].alias("kind"),
        "temp",
    )


def asymmetry(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Absolute right/left difference for every position measured on both sides."""
    present = set(df.columns)
    pairs = [
        (p, k) for p in POSITIONS for k in KINDS if {f"R{p} {k}", f"L{p} {k}"} <= present
    ]
    return df.select(
        *keep,
        *[F.abs(F.col(f"`R{p} {k}`") - F.col(f"`L{p} {k}`")).alias(f"diff{p}_{k}") for p, k in pairs],
    )


def take_slice(df: DataFrame, order: str, start: int, rows: int) -> DataFrame:
    """``rows`` rows after the first ``start`` ones, by an ordering column."""
    return df.orderBy(order).offset(start).limit(rows)
