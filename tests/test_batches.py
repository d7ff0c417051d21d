"""One batch is read out of one row group."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from caseloom.operators.splitting import shuffled_batches
from caseloom.sources import batches as B


@pytest.fixture(scope="module")
def stored_batches(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("batches") / "b")
    df = spark.range(20_000).withColumn("payload", F.repeat(F.lit("x"), 50))
    table = shuffled_batches(df, "id", batch_size=16)
    B.write_batches(table, path, batch_size=16, batches_per_group=8)
    return path, table


def groups_with(path, number):
    hit = rows = 0
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.to_arrow_schema().get_field_index("batch_id")
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            if stats.min <= number <= stats.max:
                hit, rows = hit + 1, rows + meta.row_group(g).num_rows
    return hit, rows


def test_a_batch_lies_in_few_row_groups(stored_batches):
    path, _ = stored_batches
    for number in (0, 7, 8, 500, 1249):
        hit, rows = groups_with(path, number)
        assert 1 <= hit <= 2 and rows <= 2 * 8 * 16


def test_the_rows_of_other_groups_are_not_read(spark, stored_batches):
    path, table = stored_batches
    one = B.read_batch(spark, path, 500)
    assert "PushedFilters: [IsNotNull(batch_id), EqualTo(batch_id,500)]" in one._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in one.collect()) == sorted(r.id for r in table.where("batch_id = 500").collect())
    plan = one._jdf.queryExecution().executedPlan()
    scans, todo = [], [plan]
    while todo:
        node = todo.pop()
        if "Scan parquet" in node.nodeName():
            scans.append(node)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    read = scans[0].metrics().get("numOutputRows").get().value()
    assert 16 <= read <= 2 * 8 * 16


def test_steps_and_edges(spark, stored_batches, tmp_path):
    path, table = stored_batches
    assert B.read_steps(spark, path, 4, 7).count() == 64
    assert B.read_batch(spark, path, -1).count() == 0
    empty = str(tmp_path / "e")
    B.write_batches(table.where("id < 0"), empty)
    assert B.read_batch(spark, empty, 0).count() == 0
