import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from invented import prose
from pyspark.sql import functions as F
from test_bands import brute as counted

from caseloom.llm import quality, samples


def test_statistics_are_finite(edge_rows):
    found = quality.statistics(pa.array([t for _, t in edge_rows], pa.string()))
    assert found.shape == (len(edge_rows), len(quality.STATISTICS)) and np.isfinite(found).all()


def test_statistics_equal_brute_force(edge_rows):
    texts = [t for _, t in edge_rows] + ["Ab 12, 3.5!\n\nAb  CDE é日\r\n$5 #x", "a b c d e " * 6, "A" * 300, "\n" * 9, " x" * 4097]
    found = quality.statistics(pa.array(texts, pa.string()))
    for text, row in zip(texts, found):
        text = text or ""
        words, data = re.findall(r"[^\x20\x09-\x0D]+", text), text.encode()
        n_words, word_chars, symbols, again, repeated = counted(text)
        some, size, lines = max(n_words, 1), max(len(data), 1), text.count("\n") + 1
        share = lambda pattern: np.sqrt(len(re.findall(pattern, data)) / size)  # noqa: E731, B023
        lengths = [len(w.encode()) for w in words]
        wanted = {
            "words": np.log1p(n_words), "word_chars": word_chars / some, "symbols": np.sqrt(symbols / size),
            "digits": share(rb"[0-9]"), "capitals": share(rb"[A-Z]"), "signs": share(rb"[!\"'(),\-./:;?@\[\\\]^_`{}~+=]"),
            "lines": np.log1p(lines), "dup_lines": np.sqrt(again / lines), "repeats": np.sqrt(repeated / some),
            "variety": np.log(max(len(set(words)), 1)) / np.log(some + 1), "longest": np.log1p(max(lengths, default=0)),
            "top_word": np.sqrt(max(Counter(words).values(), default=0) / some),
            "non_ascii": sum(b >= 128 for b in data) / size, "short_words": sum(n <= 3 for n in lengths) / some,
        }
        assert dict(zip(quality.STATISTICS, row)) == pytest.approx(wanted), text[:50]


def test_summed_equations_equal_one_solution(spark, make):
    table = quality.document_statistics(make([(i, prose(i, 20 + i)) for i in range(80)])).withColumn("label", F.col("doc_id") % 2)
    cosines = quality.Cosines.fit(table, cosines=16)
    rows = table.toPandas().sort_values("doc_id")
    z = cosines(rows[list(quality.STATISTICS)].to_numpy())
    penalty = np.full(z.shape[1], quality.RIDGE)
    penalty[-1] = 1e-6
    wanted = np.linalg.solve(z.T @ z + np.diag(penalty), z.T @ rows.label.to_numpy())
    found = quality.ridge_weights(table.repartition(7), cosines)
    assert np.allclose(found, wanted, atol=1e-6)


def test_cosines_approximate_the_kernel():
    rng = np.random.default_rng(0)
    n = len(quality.STATISTICS)
    many = 20_000
    cosines = quality.Cosines(np.zeros(n), np.ones(n), rng.normal(0, 1 / quality.WIDTH, (n, many)), rng.uniform(0, 2 * np.pi, many))
    x = rng.normal(size=(2, n))
    z = cosines(x)[:, :many]
    wanted = np.exp(-np.sum((x[0] - x[1]) ** 2) / (2 * quality.WIDTH**2))
    assert abs(z[0] @ z[1] - wanted) < 0.03


def test_isotonic_equals_the_min_max_formula():
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 9, 40).astype(float)
    labels = np.minimum(rng.integers(0, 9, 40), counts).astype(float)
    mean = lambda a, b: labels[a : b + 1].sum() / counts[a : b + 1].sum()
    wanted = [max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(quality.isotonic(labels, counts), wanted)


def test_scores_equal_one_computation(spark, make):
    """The whole operator against one solution, calibration by the min-max formula, over rows in one array."""
    rng = np.random.default_rng(5)
    rows = [(i, prose(i, 10 + i % 70) + " $$$ ##" * int(rng.integers(0, 1 + 6 * (i % 3 == 0)))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0 or rng.random() < 0.2)) for i in range(400)], "doc_id bigint, quality int")
    docs = make(rows).repartition(9)
    found = quality.quality_scores(docs, labels, F.col("doc_id") % 4 != 2).toPandas().sort_values("doc_id")
    table = quality.document_statistics(docs).join(labels, "doc_id")
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    known = table.withColumn("held", held).toPandas().sort_values("doc_id")
    x = known[list(quality.STATISTICS)].to_numpy()
    deviation = x.std(axis=0)
    scaled = np.clip((x - x.mean(axis=0)) / np.where(deviation.round(9) == 0, 1, deviation), -8, 8)
    random = np.random.default_rng(0)
    frequency = random.normal(0, 1 / quality.WIDTH, (x.shape[1], quality.COSINES))
    phase = random.uniform(0, 2 * np.pi, quality.COSINES)
    z = np.column_stack([np.cos(scaled @ frequency + phase) * np.sqrt(2 / quality.COSINES), scaled / 8, np.ones(len(x))])
    use, held, y = (known.doc_id % 4 != 2).to_numpy(), known.held.to_numpy(), known.quality.to_numpy()
    fit = z[use & ~held]
    penalty = np.append(np.full(z.shape[1] - 1, quality.RIDGE), 1e-6)
    raw = z @ np.linalg.solve(fit.T @ fit + np.diag(penalty), fit.T @ y[use & ~held])
    assert np.allclose(found.raw, raw, atol=1e-5)
    place = np.floor((np.clip(found.raw.to_numpy()[use & held], -0.5, 1.5) + 0.5) * quality.BINS / 2)
    bins = np.unique(place)
    good, n = (np.array([f(y[use & held][place == b]) for b in bins], float) for f in (np.sum, len))
    share = [[good[a : b + 1].sum() / max(n[a : b + 1].sum(), 1) for b in range(len(bins))] for a in range(len(bins))]
    levels = [max(min(share[a][b] for b in range(i, len(bins))) for a in range(i + 1)) for i in range(len(bins))]
    wanted = np.interp(found.raw, bins / (quality.BINS / 2) - 0.5 + 1 / quality.BINS, levels)
    assert np.allclose(found.score, wanted, atol=1e-9)


def test_scores(spark, make, edge_rows):
    good = [(100 + i, prose(i, 60)) for i in range(150)]
    bad = [(300 + i, "$$$ ### BUY " * (5 + i)) for i in range(60)]
    labels = [(d, 1) for d, _ in good] + [(d, 0) for d, _ in bad] + [(1, None), (None, 1), (100, 1)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int").withColumn("text", F.lit(3))
    docs = make(edge_rows + good + bad, extra=True)
    found = {r.doc_id: r.score for r in quality.quality_scores(docs, table, F.col("doc_id") % 3 != 0).collect()}
    assert all(0 <= s <= 1 for s in found.values())
    assert np.mean([found[d] >= 0.7 for d, _ in good]) > 0.95 and np.mean([found[d] >= 0.7 for d, _ in bad]) < 0.05


def test_no_labels_or_rows(spark, make):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.quality_scores(make([(1, "x"), (1, None)]), labels, F.lit(True)).select("score").distinct().collect() == [(0.5,)]
    assert quality.quality_scores(make([]), labels, F.lit(True)).count() == 0


def test_held_out_accuracy(spark):
    from caseloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    labels = samples.one_label(spark.read.parquet(f"{folder}/labels.parquet"), "quality")
    held = QUERIES["op8_quality_classifier"](spark, folder).where("held_out").join(labels, "doc_id")
    assert held.where("label = predicted").count() >= 0.95 * held.count()


@pytest.mark.parametrize("n", [0, 1])
def test_one_label_takes_the_largest(spark, n):
    rows = [(1, 0), (1, n), (2, None), (None, 1)]
    found = samples.one_label(spark.createDataFrame(rows, "doc_id bigint, q int"), "q").collect()
    assert [tuple(r) for r in found] == [(1, n)]
