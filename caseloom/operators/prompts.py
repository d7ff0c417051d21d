"""Render rows as prompt text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.columns import two_decimals, words
from caseloom.operators.regression import reading_columns

# Prompt prefix, separator, printed names and their columns.
PREFIX = "MWR data: "
SEPARATOR = "; "
MEDICAL = {
    "Cancer history": "Cancer family history",
    "Breast ops": "Breast operations",
}
DEMOGRAPHIC = {
    "Age": "r:AgeInYears",
    "Cycle": "Cycle",
    "Day": "Day from the first day",
    "Pregnancies": "Num of pregnancies",
    "Hormonal meds": "Hormonal medications",
}
# Order of the groups; any other name is read as "middle".
ORDERINGS = {
    "right": ("temps", "medical", "demographic"),
    "left": ("demographic", "medical", "temps"),
    "middle": ("medical", "temps", "demographic"),
}


def ordering(name: str) -> tuple[str, ...]:
    return ORDERINGS.get(name, ORDERINGS["middle"])


def reading_part(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), two_decimals(value))


def text_part(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit("nan")))


def case_parts(columns: Sequence[str]) -> dict[str, list[Column]]:
    """Parts of the three groups for a case table; absent readings are left out."""
    return {
        "temps": [reading_part(c, F.col(f"`{c}`")) for c in reading_columns(columns)],
        "medical": [text_part(k, F.col(f"`{c}`")) for k, c in MEDICAL.items()],
        "demographic": [text_part(k, F.col(f"`{c}`")) for k, c in DEMOGRAPHIC.items()],
    }


def prompt(groups: dict[str, list[Column]], order: str = "right", prefix: str = PREFIX) -> Column:
    parts = [part for name in ordering(order) for part in groups[name]]
    return F.concat(F.lit(prefix), F.concat_ws(SEPARATOR, *parts))


def with_prompt(df: DataFrame, order: str = "right", name: str = "prompt") -> DataFrame:
    """Add the prompt of every case."""
    return df.withColumn(name, prompt(case_parts(df.columns), order))


def truncation_audit(
    df: DataFrame, groups: dict[str, list[Column]], max_len: int, prefix: str = PREFIX
) -> DataFrame:
    """Per ordering and group: tokens, and tokens cut when a prompt ends at ``max_len``."""
    def count(text: Column) -> Column:
        return F.size(words(text))

    sizes = df.select(
        count(F.lit(prefix)).alias("prefix"),
        *[count(F.concat_ws(SEPARATOR, *parts)).alias(g) for g, parts in groups.items()],
    )
    rows = []
    for name, order in ORDERINGS.items():
        start = F.col("prefix")
        for group in order:
            end = start + F.col(group)
            kept = F.greatest(F.least(end, F.lit(max_len)) - start, F.lit(0))
            rows.append(
                F.struct(
                    F.lit(name).alias("ordering"),
                    F.lit(group).alias("part"),
                    F.col(group).cast("bigint").alias("tokens"),
                    (F.col(group) - kept).cast("bigint").alias("cut"),
                )
            )
            start = end
    return (
        sizes.select(F.explode(F.array(*rows)).alias("r"))
        .select("r.*")
        .groupBy("ordering", "part")
        .agg(
            F.sum("tokens").alias("tokens"),
            F.sum("cut").alias("tokens_cut"),
            F.sum((F.col("cut") > 0).cast("bigint")).alias("rows_cut"),
        )
    )
