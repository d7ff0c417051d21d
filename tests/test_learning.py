"""Classifier, batch scoring and search on small tables."""

import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from caseloom.operators import learning as L
from caseloom.operators.classes import class_metrics
from caseloom.sources import runs as store


@pytest.fixture(scope="module")
def cases(spark):
    return spark.range(400).select(
        F.col("id").alias("case_id"),
        (F.col("id") % 20).cast("double").alias("R0 int"),
        (F.col("id") % 7).cast("double").alias("L0 int"),
        F.when(F.col("id") % 20 > 9, 1).otherwise(0).alias("cancer_risk"),
    )


@pytest.fixture(scope="module")
def model(cases):
    return L.classifier(["R0 int", "L0 int"]).fit(cases)


def test_classifier_learns_and_survives_a_round_trip(cases, model, tmp_path, rows):
    scored = L.decisions(model, cases, ["case_id", "cancer_risk"])
    assert class_metrics(scored, "cancer_risk", "decision").first().accuracy > 0.95
    path = store.save_best(model, str(tmp_path))
    again = L.decisions(store.load_best(str(tmp_path)), cases, ["case_id", "cancer_risk"])
    assert rows(scored) == rows(again)
    paths = [store.save_epoch(model, str(tmp_path), e) for e in (1, 2)]
    assert len({path, *paths}) == 3


def test_rows_with_gaps_are_scored_as_null(cases):
    gaps = cases.withColumn("R0 int", F.when(F.col("case_id") % 10 != 0, F.col("R0 int")))
    gaps = gaps.withColumn("L0 int", F.when(F.col("case_id") % 10 == 1, float("nan")).otherwise(F.col("L0 int")))
    fitted = L.classifier(["R0 int", "L0 int"]).fit(L.complete_rows(gaps, ["R0 int", "L0 int"]))
    found = {r.case_id: r for r in L.decisions(fitted, gaps, ["case_id"]).collect()}
    assert len(found) == 400
    assert {i for i, r in found.items() if r.decision is None} == {i for i in range(400) if i % 10 < 2}
    assert all((r.decision is None) == (r.probability is None) for r in found.values())


def test_search_takes_sampled_parameters_of_two_stages(spark, cases):
    pipeline = L.classifier(["R0 int", "L0 int"])
    scaler, regression = pipeline.getStages()[1:]
    drawn = spark.createDataFrame(
        [(1, 0.5, "auto", True, 5), (0, 0.001, "binomial", False, None)],
        "trial int, reg double, family string, mean boolean, rounds int",
    )
    params = {"reg": regression.regParam, "family": regression.family, "mean": scaler.withMean, "rounds": regression.maxIter}
    grid = L.parameter_maps(drawn, params)
    assert grid[0] == {regression.regParam: 0.001, regression.family: "binomial", scaler.withMean: False}
    scorer = BinaryClassificationEvaluator(labelCol="cancer_risk")
    trials, _ = L.search(cases, pipeline, scorer, grid)
    found = {r.trial: r for r in trials.collect()}
    assert (found[0].family, found[0].regParam, found[0].withMean, found[0].maxIter) == ("binomial", 0.001, False, None)
    assert (found[1].family, found[1].maxIter) == ("auto", 5) and all(r.value < 0 for r in found.values())


def test_failed_batches_give_null_predictions(spark):
    def predict(batch):
        if (batch["x"] == 33).any():
            raise ValueError("bad batch")
        return batch["x"] * 2.0

    df = spark.range(100).coalesce(1).select("id", F.col("id").alias("x"))
    found = {r.id: r for r in L.batch_score(df, predict, ["id"], ["x"], batch_size=10).collect()}
    assert len(found) == 100
    assert all(found[i].failed and found[i].prediction is None for i in range(30, 40))
    assert found[33].error == "ValueError: bad batch" and found[0].error is None
    assert all(not r.failed and r.prediction == 2 * i for i, r in found.items() if i not in range(30, 40))


def test_text_predictor(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    out = L.batch_score(df, lambda batch: [t.upper() for t in batch["t"]], ["id"], ["t"], "string")
    assert {r.id: r.prediction for r in out.collect()} == {1: "A", 2: "B"}


def test_search_minimises(cases):
    rows = L.vector_column(cases.withColumn("a", F.array("`R0 int`", "`L0 int`")), "a")
    line = LinearRegression(featuresCol="features", labelCol="cancer_risk")
    grid = ParamGridBuilder().addGrid(line.regParam, [0.0, 50.0]).build()
    found, best = L.search(rows, line, RegressionEvaluator(labelCol="cancer_risk"), grid)
    values = [r.value for r in found.orderBy("trial").collect()]
    assert values[0] < values[1] and found.columns == ["trial", "regParam", "value"]
    assert best.coefficients[0] > 0.05
    logistic = LogisticRegression(labelCol="cancer_risk")
    grid = ParamGridBuilder().addGrid(logistic.maxIter, [0, 20]).build()
    found, _ = L.search(rows, logistic, BinaryClassificationEvaluator(labelCol="cancer_risk"), grid)
    values = [r.value for r in found.orderBy("trial").collect()]
    assert values[1] < values[0] <= -0.4  # a quality metric is negated


def test_input_report(cases):
    good = L.require_columns(cases, ["case_id", "cancer_risk"]).first()
    assert good.usable and good.rows == 400 and good.missing == 0
    assert not L.require_columns(cases, ["other"]).first().usable
    assert not L.require_columns(cases.where("case_id < 0"), ["case_id"]).first().usable


class _Counted:
    """A predictor that fails for bad rows and counts its calls."""

    def __init__(self):
        self.calls = 0

    def __call__(self, batch):
        self.calls += 1
        if batch["x"].isin([-1.0]).any():
            raise ValueError("bad row")
        return (batch["x"] * 2).tolist()


@pytest.mark.parametrize("bad", [[], [0], [63], [17], [3, 40], [0, 1, 2, 3]])
def test_only_bad_rows_fail_within_few_calls(bad):
    frame = pd.DataFrame({"x": [-1.0 if i in bad else float(i) for i in range(64)]})
    predict = _Counted()
    found = L.bisected(predict, frame)
    assert [i for i, (_, error) in enumerate(found) if error] == bad
    assert all(value == i * 2 for i, (value, error) in enumerate(found) if not error)
    assert predict.calls <= 1 + 2 * 6 * len(bad)  # log2(64) halvings


def test_rows_are_scored_with_a_model_loaded_once(spark, tmp_path):
    marks = str(tmp_path)

    def load():
        import uuid

        open(f"{marks}/{uuid.uuid4().hex}", "w").close()
        return 10.0

    def predict(model, batch):
        if (batch["a.b"] == 13).any():
            raise ValueError("thirteen")
        return [{"loss": model * v, "text": f"row {v}"} if v != 14 else None for v in batch["a.b"].tolist()]

    df = spark.range(200).select(F.col("id").alias("a.b"), (F.col("id") % 3).alias("c0"), F.lit("x").alias("result")).coalesce(2)
    found = L.score_rows(df, load, predict, ["a.b", "result"], ["a.b"])
    assert found.columns == ["a.b", "result", "result", "failed", "error"]
    rows = {r[0]: r for r in found.collect()}
    assert [k for k, r in rows.items() if r.failed] == [13] and rows[13][2] is None and "thirteen" in rows[13].error
    assert rows[14][2] is None and not rows[14].failed
    assert rows[7][2] == (70.0, "row 7") and len(rows) == 200
    import os

    assert 1 <= len(os.listdir(marks)) <= 8  # one for each worker, not one for each batch
    assert L.score_rows(df.where(F.lit(False)), load, predict, ["a.b"], ["a.b"]).count() == 0
    plain = L.score_rows(df, lambda: 1, lambda m, b: b["c0"].tolist(), ["a.b"], ["c0"], "bigint", name="p")
    assert {r.p for r in plain.collect()} == {0, 1, 2}


def test_a_wrong_number_of_predictions_fails(spark):
    found = L.score_rows(spark.range(4), lambda: 1, lambda m, b: [1.0], ["id"], ["id"], "double").collect()
    assert all(r.result == 1.0 for r in found)  # alone, each row gets its one prediction
    none = L.score_rows(spark.range(4), lambda: 1, lambda m, b: [], ["id"], ["id"], "double").collect()
    assert all(r.failed and "0 predictions for 1 rows" in r.error for r in none)
