import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import importance


@pytest.fixture(scope="module")
def trials(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        a, b, c = rng.random(), rng.uniform(-5, 5), rng.randint(0, 20)
        rows.append((i, a, b, c, 3 * a + (b > 0) * (c > 10) * 2.0 + 0.01 * rng.random()))
    rows += [(1000, None, 1.0, 2, 3.0), (1001, 0.1, float("nan"), 2, 3.0), (1002, 0.1, 1.0, 2, None)]
    return spark.createDataFrame(rows, "trial int, a double, b double, c int, value double")


def brute(leaves, n):
    """Variance parts of one tree on the grid of all its bounds."""
    cuts = [sorted({0.0, 1.0} | {x for _, low, high in leaves for x in (low[i], high[i])}) for i in range(n)]
    widths = [np.diff(c) for c in cuts]
    grid = np.zeros([len(w) for w in widths])
    for cell in itertools.product(*(range(len(w)) for w in widths)):
        middle = [(cuts[i][k] + cuts[i][k + 1]) / 2 for i, k in enumerate(cell)]
        grid[cell] = next(v for v, low, high in leaves if all(low[i] <= m <= high[i] for i, m in enumerate(middle)))

    def averaged(keep):
        out = grid
        for i in reversed(range(n)):
            if i not in keep:
                out = np.tensordot(out, widths[i], axes=(i, 0))
        return out

    def square(keep):
        out = averaged(keep) ** 2
        for i in reversed(range(len(keep))):
            out = np.tensordot(out, widths[keep[i]], axes=(i, 0))
        return float(out)

    mean = square(())
    single = {(i,): square((i,)) - mean for i in range(n)}
    pairs = {(i, j): square((i, j)) - mean - single[i,] - single[j,] for i, j in itertools.combinations(range(n), 2)}
    return single | pairs, square(tuple(range(n))) - mean


def test_parts_equal_a_grid_and_add_up(spark, trials):
    params = ["a", "b", "c"]
    known = trials.dropna().where(~F.isnan("b"))
    scaled = importance.param_scaled(known.select(*(F.col(c).cast("double").alias(c) for c in (*params, "value"))), params)
    model = importance.forest(scaled, params, "value", trees=4, depth=4)
    found = importance.boxes(spark, model, 3)
    parts = importance.variance_parts(found, params).collect()
    boxes = found.collect()
    for tree in range(4):
        leaves = [(r.value, r.low, r.high) for r in boxes if r.tree == tree]
        assert abs(sum(np.prod(np.subtract(h, l)) for _, l, h in leaves) - 1) < 1e-12
        wanted, total = brute(leaves, 3)
        mine = {(r.param, r.other): r.variance for r in parts if r.tree == tree}
        for subset, variance in wanted.items():
            name = (params[subset[0]], params[subset[1]] if len(subset) == 2 else None)
            assert mine[name] == pytest.approx(variance, abs=1e-12)
        assert sum(mine.values()) == pytest.approx(total, abs=1e-12)
        assert all(r.total == pytest.approx(total, abs=1e-12) for r in parts if r.tree == tree)


def test_what_matters_is_found(trials):
    found = {(r.param, r.other): r.importance for r in importance.param_fanova(trials, ["a", "b", "c"], "value", trees=8).collect()}
    assert sum(found.values()) == pytest.approx(1)
    assert found["a", None] > found["b", None] > 0.05 and found["b", "c"] > 0.05 > found["a", "b"]


def test_equal_values_and_one_parameter(spark):
    rows = spark.createDataFrame([(float(i), 1.0) for i in range(20)], "a double, value double")
    found = importance.param_fanova(rows, ["a"], "value", trees=2).collect()
    assert {(r.param, r.importance) for r in found} == {("a", 0.0), (None, 0.0)}
    rising = importance.param_fanova(rows.withColumn("value", F.col("a")), ["a"], "value", trees=2).collect()
    assert {r.param: round(r.importance, 9) + 0.0 for r in rising} == {"a": 1.0, None: 0.0}
