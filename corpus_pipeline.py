"""Cleaning of a document table in stages, ending with token ids.

Each stage takes (spark, docs, sf_dir) and returns a table with the columns of
documents; the last one returns token ids. A stage works on all rows its predecessor
kept. Stages are written as Parquet to the shared folder and read back in between.

Empty tables pass through. Null and empty texts are kept by every stage (they are not
toxic, linked with nothing, and hold no passage). Rows are judged one by one, also where
they share a doc_id or have none; of similar rows that with the smallest doc_id stays, one
without doc_id only where all lack one. Extra columns pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import decontaminate, jaccard, pieces, samples, substrings, toxicity
from caseloom.llm.arrow import crc_mod
from caseloom.session import stored

MODEL = "piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score accepts."""
    sample = samples.labelled_texts(docs, _table(spark, sf_dir, "labels"), "toxic", crc_mod(F.col("doc_id"), 5) != 0)
    return toxicity.accepted(docs, toxicity.learn(sample))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of every group of similar ones."""
    if docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        return docs.join(_later(docs), "doc_id", "left_anti").select(_columns(docs))
    # ids that do not tell rows apart: places in their order stand in
    ranked = docs.repartitionByRange(F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last())
    ranked = stored(ranked.select(F.monotonically_increasing_id().alias("place"), F.struct(*_columns(docs)).alias("row")), "ranked")
    gone = _later(ranked.select(F.col("place").alias("doc_id"), "row.text")).withColumnRenamed("doc_id", "place")
    return ranked.join(gone, "place", "left_anti").select("row.*")


def _later(docs: DataFrame) -> DataFrame:
    """The doc_ids that are similar to a smaller one."""
    found = jaccard.near_duplicates(docs, counts=False)
    return found.where((F.col("n_shingles") > 0) & (F.col("doc_id") != F.col("component_id"))).select("doc_id")


def _columns(docs: DataFrame) -> list[Column]:
    """All columns, also those whose names hold dots or backticks."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in docs.columns]


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words that start earlier; others stay as they are."""
    found = substrings.remove_repeats(docs)
    changed = F.col("n_removed") > 0
    columns = {"doc_id": F.col("doc_id"), "text": F.when(changed, F.col("kept")).otherwise(F.col("text"))}
    for name in docs.columns:
        columns.setdefault(name, F.col("row").getField(name))
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length("kept").cast("bigint")).otherwise(columns["n_chars"])
    return found.select(*(columns[name].alias(name) for name in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded text."""
    found = pieces.encode(docs, public_tokenizers.path(MODEL), extra=["ids"])
    return found.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_similar),
    ("substring_dedup", remove_repeated_passages),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

# learned scores, edit distances and piece merges are not SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
