"""Removal of repeated lines, with levelled sorted runs of line hashes.

A run is a table of line hashes, cut into buckets by hash and sorted, so that a batch is
joined against all runs bucket by bucket without moving them. Documents come in batches
from the largest doc_id down. The join removes the hashes whose outcome is already
settled; the others become a run of level 0. When a level has ``fanout`` runs they are
merged into one run of the next level, so a hash is rewritten a logarithmic number of
times. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.session import new_folder, shuffle_partitions, stored

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HASH = ["h1", "h2"]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    plain = F.octet_length(c) == F.length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


@dataclass(frozen=True)
class Run:
    """A written run: as a table that knows its buckets, and as plain files."""

    table: DataFrame
    files: DataFrame


class LineRuns:
    """Which lines are in at least ``min_docs`` documents, and the largest document of each.

    ``add`` takes batches (columns h1, h2 and doc_id, one row for each line) whose
    documents are all different. Repeated lines of a document count once. Any order of
    batches gives the same result; from the largest doc_id down the runs stay smallest.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 3, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[Run]] = []

    def _written(self, run: DataFrame) -> Run:
        """``run`` as a table of hash buckets, each sorted by hash."""
        folder = new_folder(self.spark, "run")
        name = "run_" + folder.rpartition("-")[2]
        buckets = run.write.bucketBy(shuffle_partitions(run), *HASH).sortBy(*HASH)
        buckets.option("path", folder).format("parquet").saveAsTable(name)
        table = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name goes, the files stay
        return Run(table, self.spark.read.schema(run.schema).parquet(folder))

    def _merged(self, runs: list[Run]) -> DataFrame:
        # a union of bucketed tables has no common buckets, though Spark 4.1 plans as if it had
        union = reduce(DataFrame.union, (run.files for run in runs))
        return union.groupBy(*HASH).agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))

    @property
    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        new = lines.groupBy(*HASH).agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("keeper"))
        for run in self.runs:
            settled = run.table.where(F.col("docs") >= self.min_docs).select(*(F.col(c).alias(f"_{c}") for c in (*HASH, "keeper")))
            same = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
            new = new.join(settled, same & (F.col("keeper") <= F.col("_keeper")), "left_anti")
        self._put(self._written(new), 0)

    def _put(self, run: Run, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged = self._written(self._merged(self.levels[level]))
            self.levels[level] = []
            self._put(merged, level + 1)

    def repeated(self) -> DataFrame:
        """Columns h1, h2 and keeper of the lines in ``min_docs`` or more documents."""
        return self._merged(self.runs).where(F.col("docs") >= self.min_docs).select(*HASH, "keeper")


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, row (hash of the text), pos (from 0) and hash of every line with a long enough key.

    The key is the line without blanks at both ends and with A-Z in lower case; two
    64-bit hashes stand for it.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    lines = rows.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.select("doc_id", "row", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.length("key") >= min_chars)
    keys = keys.select("doc_id", "row", "pos", ascii_lower(F.col("key")).alias("key"))
    return keys.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def remove_repeated_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 8, fanout: int = 4, texts: bool = True
) -> DataFrame:
    """What stays of every text without the lines that ``min_docs`` documents share.

    Lines end at line feeds; a null or empty text is one empty line. Lines whose key (see
    ``line_hashes``) has ``min_chars`` code points and stands in ``min_docs`` different
    doc_ids go, except those in the largest of these doc_ids. Returns one row per input
    row: doc_id, n_lines, n_dropped, kept_sha256 and, with ``texts``, kept.

    Rows that share a doc_id are one document, each judged by its own lines. A row
    without doc_id is no document: it loses nothing and counts for nothing. An empty
    table gives an empty one; other columns are ignored. A line repeated inside its
    largest document stays there each time. Texts are read twice and exchanged once, at the
    end; a frequent line is a single row of a run, and the join that finds its places
    may be split by AQE.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    shares = [i / batches for i in range(1, batches)]
    cuts = (docs.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] or []) if shares else []
    later = [(F.col("doc_id") <= cut).cast("int") for cut in sorted(set(cuts))]
    folder = new_folder(spark, "lines")
    hashes = line_hashes(docs, min_chars).withColumn("batch", sum(later, F.lit(0)))
    hashes.write.partitionBy("batch").parquet(folder)
    lines = spark.read.schema(hashes.schema).parquet(folder)
    runs = LineRuns(spark, min_docs, fanout)
    for batch in range(len(later) + 1):
        runs.add(lines.where(F.col("batch") == batch))
    repeated = stored(runs.repeated(), "repeated")
    gone = lines.join(repeated, HASH).where(F.col("doc_id") < F.col("keeper"))
    gone = gone.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("gone"))
    # split before the join, so that no later expression splits the text again for each line
    whole = docs.select("doc_id", F.xxhash64("text").alias("row"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    placed = whole.join(gone, ["doc_id", "row"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))
    out = placed.select(
        "doc_id",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept"),
    )
    digest = F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256")
    return out.select("doc_id", "n_lines", "n_dropped", digest, *(["kept"] if texts else []))
