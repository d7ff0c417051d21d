"""The stages against plain versions, and all registered queries of the subpackage."""

import pytest
from invented import prose
from oracle import compare, connect

import __spark_entry__ as driver
import corpus_pipeline
from caseloom.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with toxic, similar, repeated and leaked texts among clean ones."""
    path = str(tmp_path_factory.mktemp("tables"))
    passage, item = prose(900, 60), prose(901, 25)
    rows = [(i, prose(i, 80)) for i in range(100)]
    rows += [(100 + i, prose(100 + i, 50) + " dumbhead and scumbag") for i in range(40)]
    rows += [(200, rows[3][1]), (201, rows[4][1] + " more")]
    rows += [(300 + i, f"{prose(300 + i, 40)} {passage} {prose(400 + i, 40)}") for i in range(5)]
    rows += [(500, f"{prose(500, 40)} {item} {prose(501, 20)}"), (600, None), (601, ""), (None, prose(7000, 30))]
    rows += [(700, prose(700, 30)), (700, prose(700, 30)), (700, prose(701, 30))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.selectExpr("*", "'en' AS lang", "'s' AS source", "cast(length(text) as bigint) AS n_chars", "1 AS tie").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(100 <= i < 140)) for i in range(140)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect_and_leave_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {(r.doc_id, r.text) for r in docs.collect()}
    columns, ids = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        ids.append(sorted(str(r.doc_id) for r in docs.collect()))
    every = sorted(str(d) for d, _ in before)
    toxic = {str(i) for i in range(100, 140)}
    assert sorted(set(every) - set(ids[0])) == sorted(toxic)
    assert ids[1] == sorted([*(x for x in ids[0] if x not in ("200", "201", "700")), "700", "700"])
    assert ids[2] == ids[1] and sorted(set(ids[2]) - set(ids[3])) == ["500"]
    after = {(r.doc_id, r.text) for r in docs.collect()}
    assert len({(d, t) for d, t in before if d in range(100)} - after) == 0
    assert {t for d, t in after if d in (301, 302, 303, 304)} == {f"{prose(d, 40)} {prose(d + 100, 40)}" for d in range(301, 305)}
    assert (600, None) in after and (601, "") in after


def test_similar_rows_without_ids_or_with_repeated_ones(spark):
    x, y, z = prose(1, 40), prose(2, 40), prose(3, 40)
    rows = [(1, x), (5, x), (5, y), (None, x), (None, z), (9, z + " end"), (9, None), (9, None), (None, ""), (7, ""), (3, y)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS `a.b`", "2 AS `c``d`", "3 AS label")
    kept = corpus_pipeline.keep_one_of_similar(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    found = sorted(((r[0], r[1]) for r in kept.collect()), key=str)
    assert found == sorted([(1, x), (3, y), (9, z + " end"), (9, None), (9, None), (None, ""), (7, "")], key=str)


def test_dotted_columns_pass_all_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 120").selectExpr("*", "1 AS `a.b`")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert "a.b" in docs.columns and docs.count() >= 100


def test_run_returns_ids_of_all_that_is_kept(spark, folder):
    found = corpus_pipeline.run(spark, folder).collect()
    assert len(found) == 100 + 5 + 2 + 1 + 2
    assert all(len(r.ids) == r.n_tokens and r.ids[0] == 1 and r.ids[-1] == 2 for r in found)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql_on_a_larger_table(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name) is None


def test_all_are_registered():
    assert len(QUERIES) == 14 and set(QUERIES) <= set(driver.queries()) and set(SQL) <= set(QUERIES)
