"""Splits, batches and steps."""

import math

import pytest
from pyspark.sql import functions as F

from caseloom.operators import splitting as S


def sizes(df):
    found = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    return tuple(found.get(s, 0) for s in ("train", "val", "test"))


@pytest.mark.parametrize(
    "n, wanted", [(10, (7, 1, 2)), (100, (70, 15, 15)), (101, (70, 15, 16)), (1, (0, 0, 1)), (3000, (2100, 450, 450))]
)
@pytest.mark.parametrize("digits", [1, 4])
def test_exact_sizes(spark, n, wanted, digits):
    assert sizes(S.exact_split(spark.range(n), "id", digits=digits)) == wanted


def test_empty_table(spark):
    assert sizes(S.exact_split(spark.range(0), "id")) == (0, 0, 0)


def test_split_is_repeatable_complete_and_disjoint(spark):
    ids = spark.range(1000)
    first = S.exact_split(ids, "id", seed=7)
    again = S.exact_split(ids.repartition(13, (F.col("id") * 17) % 5), "id", seed=7)
    assert first.exceptAll(again).count() == 0
    other = S.exact_split(ids, "id", seed=8)
    assert first.exceptAll(other).count() > 0
    parts = [first.where(F.col("split") == s).select("id") for s in ("train", "val", "test")]
    assert parts[0].intersect(parts[1]).count() == parts[1].intersect(parts[2]).count() == 0
    assert parts[0].unionAll(parts[1]).unionAll(parts[2]).exceptAll(ids).count() == 0


def test_split_equals_a_full_sort(spark):
    import hashlib

    ordered = sorted(range(500), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
    wanted = {i: "train" if r < 350 else "val" if r < 425 else "test" for r, i in enumerate(ordered)}
    assert {r.id: r.split for r in S.exact_split(spark.range(500), "id").collect()} == wanted


def test_table_is_not_shuffled_for_the_split(spark):
    wide = spark.range(1000).withColumn("payload", F.lit("x"))
    plan = S.exact_split(wide, "id")._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main and "Window" not in main


def test_hash_split_shares(spark):
    train, val, test = sizes(S.hash_split(spark.range(20000), "id"))
    assert abs(train / 20000 - 0.7) < 0.02 and abs(val / 20000 - 0.15) < 0.02 and train + val + test == 20000


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_shuffled_batches(spark, digits):
    batched = S.shuffled_batches(spark.range(100).withColumn("x", F.col("id") * 2), "id", digits=digits)
    assert batched.columns == ["id", "x", "batch_id", "step_id"]
    per_batch = {r.batch_id: r["count"] for r in batched.groupBy("batch_id").count().collect()}
    assert per_batch == {**{b: 16 for b in range(6)}, 6: 4}
    assert {r.step_id for r in batched.collect()} == {0, 1}
    next_epoch = S.shuffled_batches(spark.range(100), "id", epoch=1, digits=digits)
    assert batched.drop("x").exceptAll(next_epoch).count() > 0


def test_order_does_not_depend_on_bucket_digits(spark):
    one, four = (S.shuffled_batches(spark.range(300), "id", digits=d) for d in (1, 4))
    assert one.exceptAll(four).count() == 0


@pytest.mark.parametrize("segments", [1, 5])
def test_sequential_batches(spark, segments):
    ids = spark.range(100).select((F.col("id") ** 2).cast("long").alias("id"))
    batched = S.sequential_batches(ids, "id", batch_size=16, accumulate=4, segments=segments)
    found = {r.id: (r.batch_id, r.step_id) for r in batched.collect()}
    assert found == {i * i: (i // 16, i // 64) for i in range(100)}
    first = batched.where("batch_id = 0").count()
    assert first == 16


def test_batch_counts(spark):
    row = S.batch_counts(spark.range(100)).first()
    assert (row.rows, row.batches, row.steps) == (100, math.ceil(100 / 16), 2)
