"""Class and text metrics against known values and brute force."""

import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from caseloom.operators import classes as C
from caseloom.operators import texts as T
from caseloom.plans.evaluation import evaluate


@pytest.fixture(scope="module")
def golden(spark):
    data = zip(range(4), (0, 1, 0, 1), (0, 1, 1, 1), (0.0, 1.0, 1.0, 1.0))
    return spark.createDataFrame(list(data), "row_id long, y int, p int, score double")


def test_golden_classes(golden):
    row = C.class_metrics(golden, "y", "p").first()
    assert (row.accuracy, row.f1, row.sensitivity, row.specificity) == (0.75, 0.8, 1.0, 0.5)
    assert C.roc_auc(golden, "y", "score").first()[0] == 0.75


def test_one_class_only(golden):
    ones = golden.where("y = 1")
    assert C.roc_auc(ones, "y", "score").first()[0] is None
    assert C.class_metrics(ones, "y", "p").first().specificity is None
    none = C.class_metrics(golden.where("y = 0 and p = 0"), "y", "p").first()
    assert (none.accuracy, none.f1, none.sensitivity) == (1.0, 0.0, None)


@pytest.mark.parametrize("segments", [1, 3, 50])
def test_auc_equals_evaluator(spark, segments):
    random.seed(9)
    data = [(random.randint(0, 1), float(random.choice([0, 0, 0, 1, 2, 5, 7, random.random()]))) for _ in range(600)]
    df = spark.createDataFrame(data, "y int, score double")
    wanted = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0).evaluate(df)
    auc = C.roc_auc(df, "y", "score", segments).first()[0]
    assert auc == pytest.approx(wanted, abs=1e-12)
    flipped = C.roc_auc(df.withColumn("score", -F.col("score")), "y", "score", segments).first()[0]
    bent = C.roc_auc(df.withColumn("score", F.exp("score")), "y", "score", segments).first()[0]
    assert flipped == pytest.approx(1 - auc) and bent == pytest.approx(auc)


def brute_meteor(hyp, ref):
    hyp, ref = (list(enumerate(t.lower().split())) for t in (hyp, ref))
    n_hyp, n_ref, met = len(hyp), len(ref), []
    for i, word in reversed(hyp):
        for k in range(len(ref) - 1, -1, -1):
            if ref[k][1] == word:
                met.append((i, ref.pop(k)[0]))
                break
    if not met:
        return 0.0
    met.sort()
    chunks = 1 + sum(1 for a, b in zip(met, met[1:]) if (b[0] - a[0], b[1] - a[1]) != (1, 1))
    p, r = len(met) / n_hyp, len(met) / n_ref
    return p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * (chunks / len(met)) ** 3)


def test_meteor_equals_loop(spark):
    random.seed(4)
    sentence = "This is a simple test sentence"
    pairs = [(sentence, sentence), ("no common", "words here"), ("", "x"), (" ", "\n"), (None, "a"), ("A b a", "a B a c")]
    for _ in range(60):
        pairs.append(tuple(" ".join(random.choices("a b c d e f".split(), k=random.randint(1, 12))) for _ in "xy"))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "row_id long, prediction string, reference string")
    found = {r.row_id: r.meteor for r in T.meteor(df).collect()}
    for i, (hyp, ref) in enumerate(pairs):
        assert found[i] == pytest.approx(brute_meteor(hyp or "", ref or ""), abs=1e-12), pairs[i]
    assert found[0] == pytest.approx(0.9976851851851852, abs=1e-15)


@pytest.fixture(scope="module")
def pairs(spark):
    data = [(i, None if i % 4 == 0 else " \n" if i % 4 == 1 else f" p{i} ", f"r{i}\n") for i in range(20)]
    return spark.createDataFrame(data, "row_id long, prediction string, reference string")


def test_blank_pairs(pairs):
    kept = T.nonblank_pairs(pairs).collect()
    assert len(kept) == 10 and all(r.prediction == f"p{r.row_id}" and r.reference == f"r{r.row_id}" for r in kept)
    shown = T.rejected_pairs(pairs).collect()
    assert sorted(r.row_id for r in shown) == [0, 1, 4, 5, 8] and {r.more for r in shown} == {5}
    assert T.rejected_count(pairs).first()[:] == (10, 20)


def test_rejected_pairs_show_their_input(spark, pairs):
    inputs = spark.createDataFrame([(i, f"asked {i}") for i in range(20) if i != 4], "row_id long, asked string")
    shown = T.rejected_pairs(pairs, inputs=inputs)
    assert {r.row_id: (r.asked, r.more) for r in shown.collect()} == {
        i: (None if i == 4 else f"asked {i}", 5) for i in (0, 1, 4, 5, 8)
    }
    assert T.rejected_pairs(pairs.where("row_id % 4 > 1"), inputs=inputs).count() == 0


def brute_match(hyp, ref):
    cosine = np.array([[a @ b / np.linalg.norm(a) / np.linalg.norm(b) for b in ref] for a in hyp])
    p, r = cosine.max(axis=1).mean(), cosine.max(axis=0).mean()
    return p, r, 2 * p * r / (p + r)


@pytest.mark.parametrize("block", [1, 2, 256])
def test_embedding_match_equals_numpy(spark, block):
    rng = np.random.default_rng(6)
    data, wanted = [], {}
    for pair in range(5):
        sides = [rng.normal(size=(rng.integers(1, 7), 4)) for _ in range(2)]
        if pair == 0:
            sides[1] = sides[0]
        wanted[pair] = brute_match(*sides)
        for name, vectors in zip(("hyp", "ref"), sides):
            data += [(pair, name, i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(data, "row_id long, side string, pos long, vector array<double>")
    found = {r.row_id: (r.precision, r.recall, r.f1) for r in T.embedding_match(df, block=block).collect()}
    assert set(found) == set(wanted)
    for pair, scores in wanted.items():
        assert found[pair] == pytest.approx(scores)
    assert found[0] == pytest.approx((1, 1, 1))
    means = T.mean_scores(T.embedding_match(df, block=block), "f1").first().f1
    assert means == pytest.approx(np.mean([s[2] for s in wanted.values()]))
    nothing = T.mean_scores(T.embedding_match(df.where("row_id < 0")), "precision", "recall", "f1").first()
    assert nothing[:] == (None, None, None)


def test_mean_pool_with_and_without_padding(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 2.0], 1), (1, [3.0, 4.0], 1), (1, [8.0, 0.0], 0)], "id int, v array<double>, mask int"
    )
    assert T.mean_pool(df, "id", "v").first()["mean"] == [4.0, 2.0]
    assert T.mean_pool(df, "id", "v", "mask", mask_pad=True).first()["mean"] == [2.0, 3.0]


def test_align_pairs(spark, rows):
    a = spark.createDataFrame([(2, "p2"), (1, "p1")], "row_id long, prediction string")
    b = spark.createDataFrame([(1, "r1"), (2, "r2")], "row_id long, reference string")
    assert rows(T.align_pairs(a, b)) == [(1, "p1", "r1"), (2, "p2", "r2")]


def test_evaluate_summary(spark, golden, pairs):
    batches = spark.createDataFrame([(2.0,), (None,), (4.0,)], "loss double")
    found = {r.metric: r.value for r in evaluate(batches, golden, pairs).collect()}
    assert found["loss"] == 2.0 and found["accuracy"] == 0.75 and found["rejected"] == 10 and found["meteor"] == 0.0
