import pytest
from pyspark.sql import functions as F

from caseloom.operators.learning import classifier
from caseloom.plans.evaluation import evaluate, evaluate_while_writing


def test_one_pass_equals_the_separate_metrics(spark, tmp_path):
    rows = [(i, i % 2, int(i % 3 == 0), None if i % 5 == 0 else i / 10, " " if i % 4 == 0 else "text", None if i % 7 == 0 else "ref") for i in range(100)]
    df = spark.createDataFrame(rows, "id int, y int, p int, loss double, prediction string, reference string").repartition(7)
    df = df.selectExpr("*", "1 AS rows", "2 AS tp", "0.5D AS score")
    path = str(tmp_path / "out")
    found = {r.metric: r.value for r in evaluate_while_writing(df, path, required=["loss", "reference", "absent"]).collect()}
    written = spark.read.parquet(path)
    assert written.count() == 100 and written.columns == df.columns
    apart = evaluate(batches=df.select("loss"), classes=df.select("y", "p", "score"), pairs=df.select(F.col("id").alias("row_id"), "prediction", "reference"))
    apart = {r.metric: r.value for r in apart.collect()}
    for metric in ("loss", "accuracy", "f1", "sensitivity", "specificity", "rejected"):
        assert found[metric] == pytest.approx(apart[metric]), metric
    assert (found["rows"], found["missing_loss"], found["missing_reference"], found["missing_absent"]) == (100, 20, 15, 100)


def test_only_what_the_table_has_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(1.0,)], "loss double")
    found = {r.metric: r.value for r in evaluate_while_writing(df, str(tmp_path / "a")).collect()}
    assert found == {"rows": 1.0, "loss": 1.0}
    empty = spark.createDataFrame([], "loss double, y int, p int")
    found = {r.metric: r.value for r in evaluate_while_writing(empty, str(tmp_path / "b")).collect()}
    assert found == {"rows": 0.0, "loss": None, "accuracy": None, "f1": 0.0, "sensitivity": None, "specificity": None}


def test_one_scan(spark, tmp_path):
    spark.range(50).selectExpr("id AS loss", "id % 2 AS y", "id % 3 AS p").write.parquet(str(tmp_path / "in"))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    source = spark.read.parquet(str(tmp_path / "in"))
    evaluate_while_writing(source.mapInArrow(counted, source.schema), str(tmp_path / "out"), required=["y"])
    assert seen.value == 50


def test_the_session_can_still_fit_models(spark, tmp_path):
    df = spark.range(60).selectExpr("id % 2 AS y", "id % 3 AS p", "cast(id % 2 AS double) AS x")
    evaluate_while_writing(df, str(tmp_path / "o"))
    fitted = classifier(["x"], "y").fit(df)
    assert fitted.stages[2].coefficients[0] > 0
    assert spark.catalog.listTables("global_temp") == []
