"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000  # labelled documents used to fit, at most


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """doc_id and label; rows without either are left out, the largest of several labels counts."""
    known = labels.select("doc_id", F.col(name).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_texts(docs: DataFrame, labels: DataFrame, name: str, use: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text and label of at most ``rows`` labelled ids that ``use`` admits.

    The ids with the smallest hashes are taken. Their number is bounded, so they are
    broadcast and no other text is exchanged. Of rows that share a doc_id the first text
    in order of spelling counts.
    """
    ids = one_label(labels, name).where(use).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
