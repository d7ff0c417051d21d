import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import moments as M
from caseloom.operators.regression import fit_lines


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        x = None if i % 50 == 0 else float("nan") if i % 51 == 0 else rng.gauss(0, 1) + 1e6
        a = None if i % 40 == 0 else 3.0 * (x or 0) + rng.gauss(0, 1) - 1e7
        rows.append((i % 7, ["train", "test", None][i % 3], x, a, rng.random()))
    return spark.createDataFrame(rows, "file int, split string, `T1 int` double, `R0 int` double, `a.b` double")


def lines(df, by):
    return {tuple(r[c] for c in (*by, "target")): r for r in df.collect()}


@pytest.mark.parametrize("by", [[], ["split"]])
def test_merged_moments_equal_a_refit(cases, by):
    targets = ["R0 int", "a.b"]
    parts = M.line_moments(cases, targets, "T1 int", [*by, "file"])
    merged = lines(M.lines_from_moments(M.merged_moments(parts, by), by), by)
    whole = lines(fit_lines(cases, targets, "T1 int", by), by)
    assert merged.keys() == whole.keys()
    for key, wanted in whole.items():
        got = merged[key]
        assert got.pairs == wanted.pairs and got.dropped == wanted.dropped
        assert got.slope == pytest.approx(wanted.slope, rel=1e-9)
        at = wanted.control_mean
        assert got.intercept + got.slope * at == pytest.approx(wanted.intercept + wanted.slope * at, rel=1e-9)
        assert got.control_mean == pytest.approx(wanted.control_mean, rel=1e-12)


def test_new_files_update_a_line_without_the_old_ones(cases):
    old = M.line_moments(cases.where("file < 5"), ["R0 int"], "T1 int")
    new = M.line_moments(cases.where("file >= 5"), ["R0 int"], "T1 int")
    both = M.lines_from_moments(M.merged_moments(old.union(new))).first()
    assert both.slope == pytest.approx(fit_lines(cases, ["R0 int"], "T1 int").first().slope, rel=1e-9)
    # merging in any order, also step by step
    step = M.merged_moments(M.merged_moments(old).union(new))
    assert M.lines_from_moments(step).first().slope == pytest.approx(both.slope, rel=1e-12)


def test_degenerate_parts(spark):
    rows = spark.createDataFrame([(1, 2.0, 5.0), (1, 2.0, 7.0), (2, 2.0, 9.0), (3, None, 1.0), (4, 1.0, None)], "file int, x double, y double")
    parts = M.line_moments(rows, ["y"], "x", ["file"])
    alone = lines(M.lines_from_moments(parts, ["file"]), ["file"])
    assert (alone[1, "y"].slope, alone[1, "y"].intercept) == (0.0, 6.0)
    assert alone[3, "y"].slope is None and alone[4, "y"].pairs == 0
    whole = M.lines_from_moments(M.merged_moments(parts)).first()
    assert (whole.slope, whole.intercept, whole.pairs, whole.dropped) == (0.0, 7.0, 3, 2)
    assert M.merged_moments(parts.where("file > 9")).count() == 0
    assert M.lines_from_moments(M.line_moments(rows.where(F.lit(False)), ["y"], "x")).count() == 0
