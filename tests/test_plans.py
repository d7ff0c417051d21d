"""What must not appear in physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from caseloom.operators import runs, splitting
from caseloom.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
PYTHON_ALLOWED = {"batch_score", "embedding_match", "evaluate_summary", "median_prune", "score_isolated", "subword_audit"}


@pytest.fixture(scope="module")
def plans(spark):
    return {
        name: make(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        for name, make in QUERIES.items()
    }


def test_no_cross_joins(plans):
    found = [n for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert found == []


def test_python_only_where_it_is_needed(plans):
    found = {n for n, p in plans.items() if re.search(r"Python|InPandas|ArrowEval", p)}
    assert found <= PYTHON_ALLOWED


def test_scans_read_only_needed_columns(spark, plans):
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double" in plans["residual_one"].replace(
        "l_orderkey:bigint,l_linenumber:int,", ""
    )
    assert "ReadSchema: struct<o_orderkey:bigint>" in plans["split_hash"]


def test_flagship_is_two_aggregates_over_one_projection(plans):
    plan = plans["residual_two"]
    assert "Join" not in plan and "Window" not in plan and "hashpartitioning(l_" not in plan


def test_runs_are_never_gathered_in_one_window(spark):
    """Windows over rows are partitioned by run and segment."""
    df = spark.range(100).select(
        F.format_string("run %d", F.col("id") % 3).alias("run_id"), F.col("id").cast("int").alias("epoch"), F.rand(1).alias("val_loss")
    )
    plan = runs.best_so_far(df, "val_loss")._jdf.queryExecution().executedPlan().toString()
    # partition and order of every window
    windows = re.findall(r"Window \[.*\], \[([^\]]*)\], \[([^\]]*)\]", plan)
    over_rows = [keys for keys, order in windows if "epoch" in order]
    assert over_rows and all("run_id" in keys and "__segment" in keys for keys in over_rows)


def test_shuffled_batches_have_one_large_exchange(spark):
    wide = spark.range(100).withColumn("payload", F.lit("x"))
    plan = splitting.shuffled_batches(wide, "id")._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in plan.splitlines() if "Exchange" in line and "payload" in line]) <= 1
