"""Trials: sampling, pruning and reports."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from caseloom.operators import median, trials


def make_steps(n_trials, n_steps, distinct):
    random.seed(n_trials)
    return [
        (t * 3, s, float(random.randint(0, distinct)))
        for t in range(n_trials)
        for s in range(n_steps)
        if s < 2 or (t + s) % 5
    ]


@pytest.mark.parametrize("n_trials, distinct, block", [(40, 1000, 1), (40, 6, 3), (60, 10**6, 7), (60, 50, None)])
def test_median_prune_equals_loop(spark, n_trials, distinct, block):
    data = make_steps(n_trials, 8, distinct)
    df = spark.createDataFrame(random.sample(data, len(data)), "trial long, step long, value double")
    found = {(r.trial, r.step): r for r in median.median_prune(df, 5, 5, block_rows=block).collect()}
    assert len(found) == len(data)
    for trial, step, value in data:
        earlier = [v for t, s, v in data if s == step and t < trial]
        best = min(v for t, s, v in data if t == trial and s <= step)
        row = found[trial, step]
        middle = statistics.median(earlier) if earlier else None
        assert (row.value, row.best, row.earlier, row.median) == (value, best, len(earlier), middle)
        assert bool(row.prune) == (step >= 5 and len(earlier) >= 5 and best > middle)


def test_sorted_trials_with_small_blocks(spark):
    """Values that rise or fall with the trial put all of a prefix on one side."""
    for sign in (1, -1):
        df = spark.range(90).select(
            F.col("id").alias("trial"), F.lit(0).cast("long").alias("step"), (sign * F.col("id")).cast("double").alias("value")
        )
        for r in median.median_prune(df, block_rows=4).collect():
            assert r.median == (statistics.median(range(r.trial)) * sign if r.trial else None)


def test_search_space(spark):
    drawn = trials.sample_space(spark.range(400).withColumnRenamed("id", "trial")).toPandas()
    assert drawn.learning_rate.between(1e-6, 1e-4).all()
    assert 0.4 < (drawn.learning_rate < 1e-5).mean() < 0.6  # uniform in the logarithm
    assert set(drawn.batch_size) == {8, 16, 32}
    assert set(drawn.lora_rank) == set(range(4, 17))
    assert (drawn.lora_alpha.min(), drawn.lora_alpha.max()) == (16, 64)
    assert drawn.lora_dropout.between(0, 0.5).all() and drawn.gen_weight.between(0.1, 0.9).all()
    assert (abs(drawn.gen_weight + drawn.cls_weight - 1) < 1e-12).all()


def test_best_trial_and_history(spark):
    values = [5.0, 3.0, None, 3.0, 4.0, 1.0, 2.0]
    df = spark.createDataFrame(list(enumerate(values)), "trial int, value double")
    assert trials.best_trial(df).first()[:] == (5, 1.0)
    assert trials.best_trial(df.where("trial < 5")).first()[:] == (1, 3.0)
    best = [r.best_value for r in trials.trial_history(df).orderBy("trial").collect()]
    assert best == [5.0, 3.0, 3.0, 3.0, 3.0, 1.0, 1.0]


def test_reports(spark):
    df = spark.createDataFrame(
        [(i, float(i % 4), float(i % 3), 7.0, 10.0 * (i % 4)) for i in range(60)],
        "trial int, a double, b double, c double, value double",
    )
    importance = {r.param: r.importance for r in trials.param_importance(df, ["a", "b", "c"], "value").collect()}
    assert importance["a"] == pytest.approx(1.0) and importance["b"] < 0.05 and importance["c"] == 0.0
    scaled = trials.param_scaled(df, ["a", "c"])
    assert scaled.agg(F.min("a"), F.max("a"), F.max("c")).first()[:] == (0.0, 1.0, 0.0)
    assert math.isclose(scaled.where("trial = 1").first().a, 1 / 3)
    assert trials.param_slice(df, ["a", "b"], ["trial", "value"]).count() == 120
