"""Segmented scans against plain loops, with segments small enough to matter."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators.scan import (
    SEGMENT,
    Running,
    global_index,
    position,
    running,
    step_segment,
    with_value_segments,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """One run holds most rows."""
    random.seed(3)
    data = [("hot", i, float(random.randint(-50, 50))) for i in range(1, 400)]
    data += [(f"r{j}", i, float(random.randint(-50, 50))) for j in range(6) for i in range(1, 8)]
    random.shuffle(data)
    return spark.createDataFrame(data, "run string, step int, v double"), data


def brute(data, fold, through):
    out = {}
    for run in {d[0] for d in data}:
        seen = []
        for _, step, v in sorted(d for d in data if d[0] == run):
            window = seen + [v] if through else list(seen)
            out[run, step] = fold(window) if window else None
            seen.append(v)
    return out


@pytest.mark.parametrize("fold", ["sum", "min", "max"])
@pytest.mark.parametrize("through", [True, False])
@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_running_equals_loop(skewed, fold, through, rows):
    df, data = skewed
    out = running(df, ["run"], ["step"], [Running("x", fold, F.col("v"), through)], step_segment("step", rows))
    wanted = brute(data, {"sum": sum, "min": min, "max": max}[fold], through)
    assert {(r.run, r.step): r.x for r in out.collect()} == wanted


def test_running_keeps_columns_and_skips_nulls(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 4.0), ("a", 3, None)], "run string, step int, v double")
    out = running(df, ["run"], ["step"], [Running("s", "sum", F.col("v"))], step_segment("step", 1))
    assert out.columns == ["run", "step", "v", "s"]
    assert [r.s for r in out.orderBy("step").collect()] == [None, 4.0, 4.0]


@pytest.mark.parametrize("segments", [1, 3, 40])
def test_position_is_exact_and_independent_of_partitions(skewed, segments):
    df, data = skewed
    wanted = {}
    for run in {d[0] for d in data}:
        ordered = sorted((v, step) for r, step, v in data if r == run)
        wanted.update({(run, step): i + 1 for i, (_, step) in enumerate(ordered)})
    for table in (df, df.repartition(5, "v")):
        cut = with_value_segments(table, "v", "step", segments=segments)
        out = running(cut, ["run"], ["v", "step"], [position("p")])
        assert {(r.run, r.step): r.p for r in out.collect()} == wanted


def test_a_frequent_value_is_cut_by_the_tie_breaker(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1500, 7.0).otherwise(F.col("id")).alias("v"), "id")
    cut = with_value_segments(df, "v", "id", segments=10)
    largest = cut.groupBy(SEGMENT).count().agg(F.max("count")).first()[0]
    assert largest < 500
    out = running(cut, [], ["v", "id"], [position("p")])
    ordered = sorted((7.0 if i < 1500 else float(i), i) for i in range(2000))
    assert {r.id: r.p for r in out.collect()} == {i: n + 1 for n, (_, i) in enumerate(ordered)}


def test_global_index_on_composite_text_order(spark):
    random.seed(5)
    data = [(random.randint(1, 3), f"w{random.randint(0, 10**6):x}", i) for i in range(500)]
    df = spark.createDataFrame(data, "n int, w string, i int")
    out = global_index(df, [F.col("n").desc(), F.col("w").asc(), F.col("i").asc()], "rank")
    ordered = sorted(data, key=lambda d: (-d[0], d[1].encode(), d[2]))
    assert [(r.n, r.w, r.i) for r in out.orderBy("rank").collect()] == ordered
    assert out.agg(F.min("rank"), F.max("rank")).first()[:] == (1, 500)
