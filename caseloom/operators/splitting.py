"""Seeded splits, batches and optimizer steps with exact sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.columns import unit_interval
from caseloom.operators.scan import position, running, with_value_segments

# Hex digits of the hash that choose a bucket: 4 digits make 65,536 buckets.
BUCKET_DIGITS = 4


def shuffle_key(id_column: str, seed: int | str) -> Column:
    """Repeatable random order: the hash of id and seed."""
    return F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}")))


def key_bucket(key: Column, digits: int = BUCKET_DIGITS) -> Column:
    """Leading digits of the hash as a number; grows with the key."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("bigint")


def split_sizes(n: Column, train: float, val: float, test: float) -> tuple[Column, Column]:
    """Rows of the train and val parts; the rest is test."""
    n_train = F.floor(F.lit(train) * n)
    n_val = F.floor((n - n_train) * F.lit(val / (val + test)))
    return n_train.cast("bigint"), n_val.cast("bigint")


def exact_split(
    df: DataFrame,
    id_column: str,
    seed: int = 42,
    train: float = 0.7,
    val: float = 0.15,
    test: float = 0.15,
    name: str = "split",
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Label every row train, val or test with exact sizes; needs a unique id.

    The cut is found without sorting the table: bucket counts tell which bucket
    holds the last train row and the last val row, and only those two buckets
    are sorted to find the two hash values. Labelling is then a plain projection.
    """
    key = shuffle_key(id_column, seed)
    keys = df.select(key.alias("key"), key_bucket(key, digits).alias("bucket"))
    # at most 16**digits rows from here to `cuts`
    counts = keys.groupBy("bucket").agg(F.count("*").alias("rows"))
    through = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    filled = counts.select(
        "bucket",
        "rows",
        F.sum("rows").over(through).alias("end"),
        F.sum("rows").over(Window.partitionBy()).alias("n"),
    )
    n_train, n_val = split_sizes(F.col("n"), train, val, test)
    cuts = (
        filled.select(
            "bucket",
            (F.col("end") - F.col("rows")).alias("start"),
            "end",
            F.explode(
                F.array(
                    F.struct(F.lit("train").alias("cut"), n_train.alias("at")),
                    F.struct(F.lit("val").alias("cut"), (n_train + n_val).alias("at")),
                )
            ).alias("c"),
        )
        .where((F.col("start") < F.col("c.at")) & (F.col("c.at") <= F.col("end")))
        .select("bucket", "c.cut", (F.col("c.at") - F.col("start")).alias("rank"))
    )
    near = keys.join(F.broadcast(cuts), "bucket")  # two rows
    ranked = near.withColumn("here", F.row_number().over(Window.partitionBy("cut").orderBy("key")))
    ends = (
        ranked.where(F.col("here") == F.col("rank"))
        .agg(
            F.struct(
                F.max(F.when(F.col("cut") == "train", F.col("key"))).alias("train"),
                F.max(F.when(F.col("cut") == "val", F.col("key"))).alias("val"),
            ).alias("ends")
        )
        .scalar()
    )
    held = df.withColumn("__ends", ends)
    in_train, in_val = key <= F.col("__ends")["train"], key <= F.col("__ends")["val"]
    return held.withColumn(name, F.when(in_train, "train").when(in_val, "val").otherwise("test")).drop("__ends")


def hash_split(
    df: DataFrame,
    id_column: str,
    seed: int = 42,
    train: float = 0.7,
    val: float = 0.15,
    name: str = "split",
) -> DataFrame:
    """Split by the row's own hash: approximate sizes, nothing but a projection."""
    u = unit_interval(id_column, seed=seed)
    return df.withColumn(
        name, F.when(u < F.lit(train), "train").when(u < F.lit(train + val), "val").otherwise("test")
    )


def _batch_columns(batch_size: int, accumulate: int) -> dict[str, Column]:
    batch = F.floor((F.col("__position") - 1) / batch_size)
    return {"batch_id": batch, "step_id": F.floor(batch / accumulate)}


def shuffled_batches(
    df: DataFrame,
    id_column: str,
    batch_size: int = 16,
    accumulate: int = 4,
    seed: int = 42,
    epoch: int = 0,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add batch and optimizer-step ids in a seeded random order, new every epoch."""
    key = shuffle_key(id_column, f"{seed}:{epoch}")
    keyed = df.withColumn("__key", key)
    placed = running(
        keyed, [], ["__key", id_column], [position("__position")], key_bucket(F.col("__key"), digits)
    )
    return placed.withColumns(_batch_columns(batch_size, accumulate)).drop("__key", "__position")


def sequential_batches(
    df: DataFrame, id_column: str, batch_size: int = 16, accumulate: int = 4, segments: int | None = None
) -> DataFrame:
    """Add batch and optimizer-step ids in the order of a numeric id."""
    cut = with_value_segments(df, id_column, segments=segments)
    placed = running(cut, [], [id_column], [position("__position")])
    return placed.withColumns(_batch_columns(batch_size, accumulate)).drop("__position")


def batch_counts(df: DataFrame, batch_size: int = 16, accumulate: int = 4, by: str | None = None) -> DataFrame:
    """Rows, batches and optimizer steps, in all or per split."""
    batches = F.ceil(F.col("rows") / batch_size)
    return (
        df.groupBy(*([by] if by else []))
        .agg(F.count("*").alias("rows"))
        .withColumn("batches", batches)
        .withColumn("steps", F.ceil(F.col("batches") / accumulate))
    )
