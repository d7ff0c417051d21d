"""Column expressions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.functions import columns as C


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def doubles(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")


@pytest.mark.parametrize("value, label", [(0.0, 0), (-0.0, 0), (3.0, 1), (None, 1), (float("nan"), 1)])
def test_zero_label(spark, value, label):
    assert one(spark, C.zero_label(F.lit(value).cast("double"))) == label


def test_two_decimals_equals_python(spark):
    random.seed(1)
    values = [2.675, 1.005, 1.115, 0.125, 0.375, -0.125, 2.5, 36.0, -0.001, 0.0, 1e7, 0.615, 4.35, 1234567.125]
    values += [random.randint(-10**6, 10**6) / 8 for _ in range(300)]
    values += [round(random.uniform(-50, 50), 3) for _ in range(3000)]
    values += [random.uniform(-1e6, 1e6) for _ in range(1000)]
    found = doubles(spark, values).select("i", C.two_decimals("x").alias("t")).orderBy("i").collect()
    assert [r.t for r in found] == [f"{v:.2f}" for v in values]
    assert one(spark, C.two_decimals(F.lit(None))) == one(spark, C.two_decimals(F.lit(float("nan")))) == "nan"


def test_round_half_even_equals_numpy(spark):
    random.seed(2)
    values = [0.25, 0.35, -0.25, 36.65, 0.05, -0.04] + [random.randint(-9999, 9999) / 100 for _ in range(2000)]
    found = doubles(spark, values).select("i", C.round_half_even("x").alias("r")).orderBy("i").collect()
    assert [r.r for r in found] == list(np.round(np.array(values), 1))


def test_cross_entropy_is_stable(spark):
    loss = one(spark, C.cross_entropy(F.lit(1000.0), F.lit(-1000.0), F.lit(0)))
    assert loss == 0.0
    assert one(spark, C.cross_entropy(F.lit(1000.0), F.lit(-1000.0), F.lit(1))) == 2000.0
    assert math.isclose(one(spark, C.cross_entropy(F.lit(0.7), F.lit(0.3), F.lit(0))), math.log(1 + math.exp(-0.4)))


def test_decisions_of_mock_logits(spark):
    df = spark.createDataFrame([(0.7, 0.3), (0.4, 0.6)], "z0 double, z1 double")
    assert [r[0] for r in df.select(C.class_decision("z0", "z1")).collect()] == [0, 1]


def test_weighted_loss_needs_both(spark):
    assert one(spark, C.weighted_loss(F.lit(2.0), F.lit(4.0))) == 3.0
    assert one(spark, C.weighted_loss(F.lit(None).cast("double"), F.lit(4.0))) is None


@pytest.mark.parametrize(
    "seconds, text",
    [(0, "0s"), (59.9, "59s"), (60, "1m 0s"), (3599, "59m 59s"), (3600, "1h 0m 0s"), (90061.5, "25h 1m 1s")],
)
def test_duration_round_trip(spark, seconds, text):
    assert one(spark, C.duration_text(F.lit(float(seconds)))) == text
    assert one(spark, C.duration_seconds(F.lit(text))) == int(seconds)


@pytest.mark.parametrize("text", ["", "12", "1h", "5m 3", "x1s"])
def test_duration_of_other_text_is_null(spark, text):
    assert one(spark, C.duration_seconds(F.lit(text))) is None


@pytest.mark.parametrize(
    "cycle, status",
    [(None, "absent"), ("n/a", "absent"), ("-1", "absent"), ("", "absent"), ("28-35", "irregular"),
     ("28 - 35", "irregular"), ("28", "regular"), (" 30 ", "regular"), ("29.5", "regular"), ("often", "other")],
)
def test_cycle_status(spark, cycle, status):
    assert one(spark, C.cycle_status(F.lit(cycle).cast("string"))) == status


@pytest.mark.parametrize(
    "text", [" a  b ", "\n\ta b　", "a\x1cb", " ", "", "a​b", "x y\x85z", " q᠎"]
)
def test_white_space_equals_python(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(
        C.words("t").alias("w"), C.strip("t").alias("s"), C.has_text("t").alias("h")
    ).first()
    assert row.w == text.split()
    assert row.s == text.strip()
    assert row.h == bool(text.strip())


def test_missing_text(spark):
    assert one(spark, C.words(F.lit(None).cast("string"))) == []
    assert one(spark, C.has_text(F.lit(None).cast("string"))) is False
    assert one(spark, C.target_text(F.lit(None).cast("string"))) == ""
    assert one(spark, C.na_to_null(F.lit("n/a"))) is None
    assert one(spark, C.na_to_null(F.lit("na"))) == "na"


def test_cadence(spark):
    kept = spark.range(1, 13).where(C.due("id", 5)).collect()
    assert [r.id for r in kept] == [5, 10]


def test_linear_score(spark):
    vector = F.array(F.lit(1.0), F.lit(2.0))
    assert one(spark, C.linear_score(vector, [0.5, -1.0], 0.25)) == -1.25


def test_unit_interval_is_uniform_and_repeatable(spark):
    u = spark.range(5000).select(C.unit_interval("id", seed=1).alias("u"))
    low, high, mean = u.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low < 0.01 and 0.99 < high < 1 and abs(mean - 0.5) < 0.02
    assert u.exceptAll(u).count() == 0
