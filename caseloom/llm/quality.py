"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Statistics of a text are scaled and put through random cosines, which approximate a
Gaussian kernel. Every task sums the normal equations of its rows, Spark sums these
parts, and the small system that is left gives the ridge weights. Scores become
probabilities by isotonic regression on labelled documents that the weights did not see.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm import arrow
from caseloom.llm.bands import base_counts
from caseloom.llm.samples import one_label
from caseloom.session import stored

STATISTICS = (
    "words", "word_chars", "symbols", "digits", "capitals", "signs", "lines", "dup_lines", "repeats",
    "variety", "longest", "top_word", "non_ascii", "short_words",
)
COSINES = 256
RIDGE = 1.0
BRANCH = 256  # tasks whose sums are added first
WIDTH = 3.0  # of the kernel, in standard deviations of a statistic
BINS = 2_000  # of the calibration, from score -0.5 to 1.5
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(b"!\"'(),-./:;?@[\\]^_`{}~+=")] = True


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text; all finite, also for empty texts."""
    base = base_counts(texts)
    w = arrow.words(texts)
    n = len(w.offsets) - 1
    words = np.diff(w.bounds)
    some, size = np.maximum(words, 1), np.maximum(np.diff(w.offsets), 1)
    length = w.ends - w.starts
    doc = w.doc
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    pairs, times = np.unique(doc * np.int64(max(len(w.unique), 1)) + w.ids, return_counts=True)
    owner = pairs // max(len(w.unique), 1)
    different = np.bincount(owner, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, owner, times)
    lines = arrow.counts_between(w.data == 10, w.offsets) + 1
    share = lambda table: arrow.counts_between(table[w.data], w.offsets) / size
    return np.column_stack([
        np.log1p(words), base["word_chars"] / some, np.sqrt(base["n_symbols"] / size), np.sqrt(share(_DIGIT)),
        np.sqrt(share(_CAPITAL)), np.sqrt(share(_SIGN)), np.log1p(lines), np.sqrt(base["n_dup_lines"] / lines),
        np.sqrt(base["n_repeat_words"] / some), np.log(np.maximum(different, 1)) / np.log(some + 1),
        np.log1p(longest), np.sqrt(top / some), arrow.counts_between(w.data >= 128, w.offsets) / size,
        np.bincount(doc, length <= 3, n) / some,
    ])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text, in one pass."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column("doc_id"), *(pa.array(c) for c in statistics(batch.column("text")).T.copy())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *STATISTICS])

    schema = "doc_id bigint, " + ", ".join(f"{s} double" for s in STATISTICS)
    return docs.select("doc_id", "text").mapInArrow(arrow.per_slice(rows), schema)


@dataclass(frozen=True)
class Cosines:
    """Random Fourier features of scaled statistics."""

    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray

    @staticmethod
    def fit(table: DataFrame, cosines: int = COSINES, seed: int = 0) -> Cosines:
        """Scale by mean and deviation over all rows of ``table``; frequencies from a fixed seed."""
        moments = table.agg(*(f(s).alias(f"{n}_{s}") for s in STATISTICS for n, f in (("m", F.avg), ("d", F.stddev_pop)))).first()
        # rounded: the order of partial sums must not show in the scores
        mean = np.array([round(moments[f"m_{s}"] or 0.0, 9) for s in STATISTICS])
        scale = np.array([round(moments[f"d_{s}"] or 0.0, 9) or 1.0 for s in STATISTICS])
        random = np.random.default_rng(seed)
        return Cosines(
            mean, scale, random.normal(0, 1 / WIDTH, (len(STATISTICS), cosines)), random.uniform(0, 2 * np.pi, cosines)
        )

    def __call__(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.cos(scaled @ self.frequency + self.phase) * np.sqrt(2 / len(self.phase))
        return np.column_stack([waves, scaled / 8, np.ones(len(x))])


@dataclass(frozen=True)
class Model:
    cosines: Cosines
    weights: np.ndarray
    edges: np.ndarray  # calibrated score from each of these raw scores on
    levels: np.ndarray


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS])


def ridge_weights(rows: DataFrame, cosines: Cosines, ridge: float = RIDGE) -> np.ndarray:
    """Weights for ``label``: tasks sum their normal equations, Spark sums matrix row by matrix row.

    The sums are made in two levels, so no group holds a part of every task.
    """
    sent = rows.sparkSession.sparkContext.broadcast(cosines)

    def sums(batches):
        total = None
        for batch in batches:
            z = sent.value(_matrix(batch))
            part = z.T @ np.column_stack([z, batch.column("label").to_numpy(zero_copy_only=False)])
            total = part if total is None else total + part
        if total is not None:
            rows = [row.tobytes() for row in total]
            branch = np.full(len(rows), TaskContext.get().partitionId() // BRANCH, np.int32)
            places = pa.array(range(len(rows)), pa.int32())
            yield pa.RecordBatch.from_arrays([places, pa.array(branch), pa.array(rows)], ["place", "branch", "sums"])

    def added(table: pa.Table) -> pa.Table:
        # sorted parts: one result whatever the order of arrival
        parts = [np.frombuffer(b) for b in sorted(table.column("sums").to_pylist())]
        return pa.table({"place": table.column("place")[:1], "sums": pa.array([np.sum(parts, axis=0).tobytes()])})

    parts = rows.mapInArrow(sums, "place int, branch int, sums binary")
    some = parts.groupBy("place", "branch").applyInArrow(added, "place int, sums binary")
    whole = some.groupBy("place").applyInArrow(added, "place int, sums binary").collect()
    size = len(cosines.phase) + len(STATISTICS) + 1
    if not whole:
        return np.zeros(size)
    system = np.array([np.frombuffer(r.sums) for r in sorted(whole, key=lambda r: r.place)])
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-6
    return np.linalg.solve(system[:, :-1] + np.diag(penalty), system[:, -1])


def isotonic(labels: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing means closest to the bins' shares: pooled adjacent violators."""
    pools: list[list[float]] = []
    for label, count in zip(labels, counts):
        pools.append([label, count, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.concatenate([np.full(int(n), label / count) for label, count, n in pools])


def _scored(rows: DataFrame, cosines: Cosines, weights: np.ndarray, extra: tuple[str, ...]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((cosines, weights))

    def run(batches):
        for batch in batches:
            cosines, weights = sent.value
            raw = cosines(_matrix(batch)) @ weights
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), pa.array(raw)], [*extra, "raw"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in extra), "raw double"]))


def learn(table: DataFrame, labels: DataFrame, name: str, use: Column) -> Model:
    """Fit on all labelled documents that ``use`` admits; a quarter of them, by hash, calibrates."""
    cosines = Cosines.fit(table)
    known = stored(table.join(one_label(labels, name).where(use), "doc_id"), "labelled")
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    weights = ridge_weights(known.where(~held), cosines)
    place = F.floor((F.greatest(F.least("raw", F.lit(1.5)), F.lit(-0.5)) + 0.5) * (BINS / 2)).alias("place")
    bins = (
        _scored(known.where(held), cosines, weights, ("label",)).groupBy(place)
        .agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).orderBy("place").collect()
    )
    if not bins:
        return Model(cosines, weights, np.array([0.0]), np.array([0.5]))
    levels = isotonic(np.array([b.good for b in bins], float), np.array([b.n for b in bins], float))
    return Model(cosines, weights, np.array([b.place for b in bins]) / (BINS / 2) - 0.5, levels)


def score(table: DataFrame, model: Model) -> DataFrame:
    """doc_id, raw ridge value, score (0 to 1) for each row of statistics."""
    scored = _scored(table, model.cosines, model.weights, ("doc_id",))
    sent = table.sparkSession.sparkContext.broadcast((model.edges, model.levels))

    def run(batches):
        for batch in batches:
            edges, levels = sent.value
            raw = batch.column("raw").to_numpy(zero_copy_only=False)
            # between two bins the score rises linearly, so it never falls
            out = np.interp(raw, edges + 1 / BINS, levels)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("raw"), pa.array(out)], ["doc_id", "raw", "score"])

    return scored.mapInArrow(run, "doc_id bigint, raw double, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, use: Column, name: str = "quality") -> DataFrame:
    """Quality of every document, learned from the labels that ``use`` (on doc_id) admits.

    Returns doc_id, raw, score (0 to 1). Texts are read once; their statistics, a few
    numbers per document, are stored and joined with all admitted labels.

    A null or empty text has the statistics of an empty text and a score like any other.
    Several labels of one doc_id count as the largest; a labelled doc_id that stands for
    several rows is learned from each of them; null labels are left out, and without any
    label all scores are 0.5. Repeated rows come back as often as given; a null doc_id
    stays null; other columns are ignored.
    """
    table = stored(document_statistics(docs), "statistics")
    return score(table, learn(table, labels, name, use))
