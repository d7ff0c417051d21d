"""Normalisation of reading columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import regression as R


@pytest.fixture(scope="module")
def cases(spark):
    """Readings with a known slope on the control, in two splits."""
    def noise(name):
        return F.conv(F.substring(F.md5(F.concat_ws(":", "case_id", F.lit(name))), 1, 6), 16, 10) / 2**24 - 0.5

    df = spark.range(300).withColumnRenamed("id", "case_id")
    df = df.withColumns({"T1 int": F.round(34 + 2 * noise("c"), 1), "T1 sk": F.round(32 + 2 * noise("d"), 1)})
    for i, c in enumerate(["R0 int", "L3 int", "R9 sk"]):
        df = df.withColumn(c, F.round(F.col("`T1 int`") * (0.5 + i / 10) + 15 + noise(c), 1))
    return df.withColumns(
        {"r:Th": F.when(F.col("case_id") % 10 < 9, (F.col("case_id") % 4).cast("int")),
         "split": F.when(F.col("case_id") % 3 == 0, "val").otherwise("train")}
    )


def arrays(df, *names):
    pdf = df.orderBy("case_id").toPandas()
    return [pdf[n].to_numpy(dtype=float) for n in names]


def lines(fits):
    return {r.target: r for r in fits.collect()}


def test_fit_equals_numpy(cases):
    fit = lines(R.fit_lines(cases, ["R0 int", "R9 sk"], "T1 int"))
    x, y, z = arrays(cases, "T1 int", "R0 int", "R9 sk")
    for got, values in ((fit["R0 int"], y), (fit["R9 sk"], z)):
        k, b = np.polyfit(x, values, 1)
        assert math.isclose(got.slope, k, rel_tol=1e-9) and math.isclose(got.intercept, b, rel_tol=1e-9)
        assert (got.pairs, got.dropped) == (300, 0)


def test_two_stage_residual_equals_numpy(cases):
    done = R.normalise_readings(cases)
    x, w, y = arrays(cases, "T1 int", "T1 sk", "L3 int")
    for control in (x, w):
        k, b = np.polyfit(control, y, 1)
        y = np.round(y - (k * control + b), 1)
    assert np.allclose(arrays(done, "L3 int")[0], y)
    assert done.columns == cases.columns
    assert np.array_equal(arrays(done, "R9 sk")[0], arrays(cases, "R9 sk")[0])  # skin columns untouched


def test_skin_readings_on_their_own_control(cases):
    done = R.normalise_readings(cases, kinds=("sk",), controls=("T1 sk",))
    x, y = arrays(cases, "T1 sk", "R9 sk")
    k, b = np.polyfit(x, y, 1)
    assert np.allclose(arrays(done, "R9 sk")[0], np.round(y - (k * x + b), 1))


def test_unrounded_residuals_do_not_follow_the_control(cases):
    done = R.residual(cases, ["R0 int"], "T1 int", digits=None)
    assert abs(done.agg(F.corr("`R0 int`", "`T1 int`")).first()[0]) < 1e-9


def test_mean_shift_keeps_the_mean(cases):
    done = R.mean_shift(cases, ["R0 int"], "T1 int")
    before, after = (d.agg(F.avg("`R0 int`")).first()[0] for d in (cases, done))
    assert math.isclose(before, after, rel_tol=1e-12)
    x, y = arrays(cases, "T1 int", "R0 int")
    assert np.allclose(arrays(done, "R0 int")[0], y + np.polyfit(x, y, 1)[0] * (x.mean() - x))
    rounded = R.normalise_readings(cases, controls=("T1 int",), method="mean_shift")
    assert np.allclose(arrays(rounded, "R0 int")[0], np.round(arrays(done, "R0 int")[0], 1))


def test_grouped_fit_equals_separate_fits(cases, rows):
    together = R.label_and_normalise(cases, group_by=["split"])
    for split in ("train", "val"):
        alone = R.label_and_normalise(cases.where(F.col("split") == split))
        assert rows(together.where(F.col("split") == split)) == rows(alone)


def test_fit_on_train_apply_to_all(cases):
    train = cases.where("split = 'train'")
    fits = R.fit_lines(train, ["R0 int"], "T1 int")
    done = R.residual(cases, ["R0 int"], "T1 int", fits=fits)
    (tx, ty), (x, y) = arrays(train, "T1 int", "R0 int"), arrays(cases, "T1 int", "R0 int")
    k, b = np.polyfit(tx, ty, 1)
    assert np.allclose(arrays(done, "R0 int")[0], np.round(y - (k * x + b), 1))


def test_gaps_are_left_out_of_the_fit(spark):
    data = [(1.0, 3.0), (2.0, 5.0), (3.0, 7.0), (4.0, None), (5.0, float("nan")), (None, 9.0)]
    df = spark.createDataFrame(data, "x double, y double")
    fit = lines(R.fit_lines(df, ["y"], "x"))["y"]
    assert (round(fit.slope, 9), round(fit.intercept, 9), fit.pairs, fit.dropped) == (2.0, 1.0, 3, 3)
    values = [r.y for r in R.residual(df, ["y"], "x").collect()]
    assert values[3:] == [None, None, None] and all(abs(v) == 0 for v in values[:3])


def test_constant_control_and_empty_column(spark):
    df = spark.createDataFrame([(5.0, 1.0, None), (5.0, 3.0, None)], "x double, y double, z double")
    fit = lines(R.fit_lines(df, ["y", "z"], "x"))
    assert (fit["y"].slope, fit["y"].intercept) == (0.0, 2.0)
    assert fit["z"].slope is None and fit["z"].pairs == 0


def test_null_group_keeps_its_rows(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0), (None, 2.0, 2.0), ("a", 1.0, 5.0)], "g string, x double, y double")
    assert R.residual(df, ["y"], "x", ["g"]).count() == 3


def test_label_treats_missing_grade_as_risk(cases):
    done = R.label_and_normalise(cases)
    wanted = F.when(F.col("`r:Th`") == 0, 0).otherwise(1)
    assert done.where(F.col("cancer_risk") != wanted).count() == 0
    assert done.where("`r:Th` is null and cancer_risk = 1").count() == 30


def test_no_python_and_no_wide_shuffle_in_the_plan(cases):
    plan = R.normalise_readings(cases)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan and "CartesianProduct" not in plan
    main = plan.split("Subquery")[0]
    assert "hashpartitioning" not in main


def test_generated_methods_are_short_enough_to_be_compiled(spark):
    """The JVM interprets methods of more than 8,000 bytes: two stages over 20 readings took 50 µs a row."""
    names = [f"{side}{pos} int" for side in "LR" for pos in range(10)]
    x = F.col("id").cast("double")
    rows = spark.range(50).select(
        "id", *[(x * (i + 1) % 7 / 3).alias(n) for i, n in enumerate(names)], (x % 5).alias("T1 int"), (x % 3).alias("T1 sk")
    )
    done = R.normalise_readings(rows)
    done.collect()  # the final plan, with its generated stages
    stages = done._jdf.queryExecution().debug().codegenToSeq()
    assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000


def test_nan_and_missing_targets_come_out_as_null(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 2.0), (2.0, float("nan"), 4.0), (3.0, None, float("nan"))], "x double, a double, b double")
    done = R.residual(rows, ["a", "b"], "x").orderBy("x").collect()
    assert [(r.a, r.b) for r in done] == [(0.0, 0.0), (None, 0.0), (None, None)]
