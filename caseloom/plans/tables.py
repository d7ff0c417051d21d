"""Shapes of the operators' inputs, derived from the driver's tables.

The whole tables are used. Gaps and blanks are written into columns by rule,
because the tables have none of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.scan import position, running, with_value_segments
from caseloom.session import stored


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Events as training histories: a user is a run, events in time order its epochs.

    Stored once, since the operators on histories read their input twice.
    """
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    # microseconds of the local clock time, whatever the session's time zone
    day, second = F.datediff(F.to_date("ts"), F.lit("1970-01-01")), F.extract(F.lit("SECOND"), F.col("ts"))
    minutes = (day.cast("bigint") * 24 + F.hour("ts")) * 60 + F.minute("ts")
    at = minutes * 60_000_000 + (second * 1_000_000).cast("bigint")
    cut = with_value_segments(events.withColumn("at", at), "at", "event_id")
    placed = running(cut, ["user_id"], ["at", "event_id"], [position("epoch")])
    return stored(
        placed.select(F.col("user_id").alias("run_id"), "epoch", F.col("event_type").alias("kind"), "value")
    )


def batch_log(spark: SparkSession, folder: str) -> DataFrame:
    """The same events as batches, eight to an epoch; every 13th one failed."""
    step = F.col("epoch") - 1
    return history(spark, folder).select(
        "run_id",
        F.floor(step / 8).alias("epoch"),
        (step % 8).alias("batch"),
        F.when(F.col("epoch") % 13 != 0, F.col("value")).alias("loss"),
        (step % 5 + 1).alias("rows"),
    )


def checked_history(spark: SparkSession, folder: str) -> DataFrame:
    """Histories with a validation loss, missing in every fifth epoch."""
    return history(spark, folder).select(
        "run_id", "epoch", F.when(F.col("epoch") % 5 != 0, F.col("value")).alias("val_loss")
    )


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Customers in the column names of a case table, with some gaps."""
    c, key, balance = table(spark, folder, "customer"), F.col("c_custkey"), F.col("c_acctbal")
    return c.select(
        "c_custkey",
        F.when(key % 7 != 0, balance / 100).alias("R0 int"),
        (balance / 300).alias("R0 sk"),
        (balance / 150 - 3).alias("R1 int"),
        F.when(key % 5 == 0, F.lit(float("nan"))).otherwise(balance / 80).alias("L0 int"),
        (balance / 160).alias("L0 sk"),
        (F.col("c_nationkey") / 8).alias("L1 int"),
        F.col("c_mktsegment").alias("Cancer family history"),
        F.when(key % 3 != 0, F.col("c_mktsegment")).alias("Breast operations"),
        (F.col("c_nationkey") + 30).alias("r:AgeInYears"),
        cycle_text().alias("Cycle"),
        (key % 28).cast("string").alias("Day from the first day"),
        F.when(key % 4 != 0, (key % 3).cast("string")).alias("Num of pregnancies"),
        F.col("c_name").alias("Hormonal medications"),
    )


def wide_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as cases with 20 readings, two controls and a grade; some readings are missing."""
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    names = [f"{side}{pos} int" for side in "LR" for pos in range(10)]
    known = F.col("l_returnflag") != "R"
    readings = [
        F.when(known | F.lit(i % 4 != 0), price / (997 + 13 * i) + discount * i).alias(name)
        for i, name in enumerate(names)
    ]
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", *readings, F.col("l_quantity").alias("T1 int"), (F.col("l_tax") * 100).alias("T1 sk"),
        discount.alias("r:Th"),
    )


def cycle_text() -> Column:
    form, days = F.col("c_custkey") % 6, (F.col("c_nationkey") + 20).cast("string")
    return (
        F.when(form == 0, "n/a")
        .when(form == 1, "-1")
        .when(form == 2, F.concat(days, F.lit("-"), (F.col("c_nationkey") + 27).cast("string")))
        .when(form == 3, "unknown")
        .when(form == 4, days)
    )


def text_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns next to their successors; some predictions are blanked."""
    turns = table(spark, folder, "conversations")
    said = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prediction"))
    reply = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    blank = F.col("conv_id") % 7 == 0
    return said.join(reply, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("row_id"),
        F.when(blank, F.lit(" \n ")).otherwise(F.col("prediction")).alias("prediction"),
        "reference",
    )


def class_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Quality as truth, toxic as decision, document length as score."""
    labels, documents = table(spark, folder, "labels"), table(spark, folder, "documents")
    return labels.join(documents.select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", F.col("quality").alias("y"), F.col("toxic").alias("p"), F.col("n_chars").cast("double").alias("score")
    )


def logits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        "c_custkey",
        (F.col("c_acctbal") / 1000).alias("z0"),
        (F.col("c_nationkey") / 10).alias("z1"),
        (F.col("c_nationkey") % 2).alias("y"),
    )


def token_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as short token sequences: 16 vectors a pair, 8 a side."""
    return table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 16).alias("row_id"),
        F.when(F.col("vec_id") % 16 < 8, "hyp").otherwise("ref").alias("side"),
        (F.col("vec_id") % 8).alias("pos"),
        F.col("embedding").alias("vector"),
    )
