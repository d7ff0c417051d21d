"""Files in and out."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from caseloom.operators.splitting import exact_split
from caseloom.plans.preparation import prepare_cases, split_and_prepare
from caseloom.sources import cases as S
from caseloom.sources import runs as R


@pytest.fixture
def case_file(tmp_path):
    lines = ['case_id,Conclusion (Tr),r:AgeInYears,Cycle,T1 int,T1 sk,R0 int,L9 int,R9 sk,r:Th,extra']
    for i in range(40):
        text = {0: '"two\nlines"', 1: '"a ""quoted"" word, comma"', 2: "n/a", 3: ""}.get(i, f"text {i}")
        cycle = {4: "28-35", 5: "n/a", 6: "-1", 7: "None"}.get(i, "28")
        reading = {8: "nan", 9: ""}.get(i, str(34 + (i % 7) / 10))
        grade = {10: "", 11: "3.0"}.get(i, str(i % 3))
        lines.append(f"{i},{text},{40 + i},{cycle},{33 + (i % 5) / 10},{32 + (i % 4) / 10},{reading},34.5,33.1,{grade},x")
    path = tmp_path / "cases.csv"
    path.write_text("\n".join(lines) + "\n", encoding="utf8")
    return str(path)


def test_schema_has_all_columns():
    assert len(S.CASE_SCHEMA) == 53 and len(set(S.CASE_SCHEMA.names)) == 53


def test_read_cases(spark, case_file):
    df = S.read_cases(spark, case_file)
    types = dict(df.dtypes)
    assert (types["r:AgeInYears"], types["R0 int"], types["Cycle"], types["extra"]) == ("int", "double", "string", "string")
    found = {int(r.case_id): r for r in df.collect()}
    assert len(found) == 40
    texts = [found[i]["Conclusion (Tr)"] for i in range(4)]
    assert texts == ["two\nlines", 'a "quoted" word, comma', None, None]
    assert [found[i].Cycle for i in range(4, 8)] == ["28-35", None, "-1", None]
    assert found[8]["R0 int"] is None and found[9]["R0 int"] is None and found[12]["R0 int"] == 34.5
    assert found[10]["r:Th"] is None and found[11]["r:Th"] == 3


def test_missing_file(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        S.read_cases(spark, str(tmp_path / "none.csv"))


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_prepare_cases(spark, case_file, format):
    done = prepare_cases(spark, case_file, format)
    assert done.count() == 40
    assert S.processed_path(case_file).endswith("/processed_cases.csv")
    risk = {int(r.case_id): int(r.cancer_risk) for r in done.collect()}
    assert risk[0] == 0 and risk[1] == 1 and risk[10] == 1
    mean = done.agg(F.avg("`R0 int`")).first()[0]
    assert abs(mean) < 0.1
    if format == "csv":
        texts = {int(r.case_id): r["Conclusion (Tr)"] for r in done.collect()}
        assert texts[0] == "two\nlines" and texts[1] == 'a "quoted" word, comma'


def test_split_and_prepare(spark, case_file):
    cases = S.read_cases(spark, case_file).withColumn("case_id", F.col("case_id").cast("long"))
    done = split_and_prepare(cases)
    assert {r.split: r["count"] for r in done.groupBy("split").count().collect()} == {"train": 28, "val": 6, "test": 6}


def test_blanks_and_breaks_survive_a_case_file(spark, tmp_path):
    texts = ["  led", "trailed \t", 'quo"ted, "', "two\nlines", "back\\slash", '"', ",", None]
    path = str(tmp_path / "cases")
    S.write_table(spark.createDataFrame(list(enumerate(texts)), "case_id int, Cycle string"), path, "csv")
    assert {int(r.case_id): r.Cycle for r in S.read_cases(spark, path).collect()} == dict(enumerate(texts))


def test_splits_are_stored_once_and_pruned(spark, tmp_path):
    path, made = str(tmp_path / "splits"), []

    def create():
        made.append(1)
        return exact_split(spark.range(100), "id")

    assert not S.is_complete(spark, path)
    first = S.splits_or_create(spark, path, create)
    second = S.splits_or_create(spark, path, create)
    assert made == [1] and first.exceptAll(second).count() == 0
    train = second.where("split = 'train'")
    assert train.count() == 70
    assert "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().executedPlan().toString()


def test_history_is_appended(spark, tmp_path, rows):
    path = str(tmp_path / "history")
    for run, epoch in (("007", 1), ("007", 2), ("b", 1)):
        R.append_history(spark.createDataFrame([(run, epoch, 0.5)], "run_id string, epoch int, train_loss double"), path)
    assert rows(R.read_history(spark, path).select("run_id", "epoch")) == [("007", 1), ("007", 2), ("b", 1)]
    assert R.read_history(spark, path, ["b"]).count() == 1


def test_log_text(spark, tmp_path):
    path = tmp_path / "run.log"
    path.write_text(
        "Epoch 1/5, Train Loss: 2.1234, Time: 1m 5s, Total Time: 1h 0m 5s\n"
        "Epoch 5, Val Loss: 0.7000, Val Time: 9s\n"
        "Epoch 5, Val Loss: nan, Val Time: 9s, BERTScore F1: 0.8100\n"
        "Final Test Loss: 0.6500\n"
        "Final Test Loss: 0.6500, BERTScore P: 0.1000, R: 0.2000, F1: 0.3000\n"
        "Epoch x\n"
    )
    found = [r[1:] for r in R.read_log(spark, str(path)).coalesce(1).collect()]
    assert found[0] == ("epoch", 1, 5, 2.1234, 65, 3605, None, None, None)
    assert found[1] == ("check", 5, None, 0.7, 9, None, None, None, None)
    assert found[2][0] == "check" and found[2][-1] == 0.81
    assert found[3] == ("final", None, None, 0.65, None, None, None, None, None)
    assert found[4] == ("final", None, None, 0.65, None, None, 0.1, 0.2, 0.3)
    assert found[5] == ("other",) + (None,) * 8


def test_lines_are_written_as_they_are_read(spark):
    df = spark.range(1).select(
        R.epoch_line(F.lit(2), F.lit(5), F.lit(1.23456), F.lit(61.0), F.lit(3700.0)).alias("e"),
        R.check_line(F.lit(5), F.lit(0.5), F.lit(3.0)).alias("c"),
        R.check_line(F.lit(5), F.lit(0.5), F.lit(3.0), F.lit(0.25)).alias("f"),
        R.final_line(F.lit(0.5), F.lit(0.1), F.lit(0.2), F.lit(0.3)).alias("t"),
    )
    assert df.first()[:] == (
        "Epoch 2/5, Train Loss: 1.2346, Time: 1m 1s, Total Time: 1h 1m 40s",
        "Epoch 5, Val Loss: 0.5000, Val Time: 3s",
        "Epoch 5, Val Loss: 0.5000, Val Time: 3s, BERTScore F1: 0.2500",
        "Final Test Loss: 0.5000, BERTScore P: 0.1000, R: 0.2000, F1: 0.3000",
    )


def test_trials_are_written(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.0), (1, 0.5)], "trial int, value double")
    R.write_trials(df, df.where("trial = 1"), str(tmp_path))
    trials, best = R.read_trials(spark, str(tmp_path))
    assert trials.count() == 2 and best.first().value == 0.5


def test_case_file_is_parsed_once(spark, case_file, monkeypatch):
    """Three stages read the typed table, not the file."""
    from caseloom.plans import preparation

    seen = []
    work = preparation.label_and_normalise
    monkeypatch.setattr(preparation, "label_and_normalise", lambda df: seen.append(df.inputFiles()) or work(df))
    preparation.prepare_cases(spark, case_file)
    assert len(seen) == 1 and seen[0] and all(f.endswith(".parquet") for f in seen[0])


def test_prepared_cases_leave_little_on_disk(spark, tmp_path):
    """The query keeps its case file compressed, and the typed table only while the stages read it."""
    from pathlib import Path

    from caseloom.plans import tables
    from caseloom.plans.queries import QUERIES
    from caseloom.session import shared_folder

    def files():
        return {f for f in Path(shared_folder(spark).removeprefix("file://")).rglob("part-*") if f.is_file()}

    lines = spark.range(4000).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.rand(1) * 1e5).alias("l_extendedprice"),
        F.floor(F.rand(2) * 50).cast("double").alias("l_quantity"), (F.floor(F.rand(3) * 9) / 100).alias("l_tax"),
        (F.floor(F.rand(4) * 11) / 100).alias("l_discount"), F.lit("N").alias("l_returnflag"),
    )
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    before = files()
    assert QUERIES["processed_cases"](spark, str(tmp_path)).count() == 4000
    left = files() - before
    assert {f.parent.name for f in left} == {"cases.csv", "processed_cases.csv"}
    S.write_table(tables.wide_cases(spark, str(tmp_path)), str(tmp_path / "plain"), "csv")
    plain = sum(f.stat().st_size for f in (tmp_path / "plain").glob("part-*"))
    assert sum(f.stat().st_size for f in left) < 0.9 * plain


def test_compressed_case_files_are_short_and_read_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FILE_LINES", 30)
    texts = ["  led", "two\nlines", 'quo"ted, "', None] * 25
    path = tmp_path / "cases"
    df = spark.createDataFrame(list(enumerate(texts)), "case_id int, Cycle string").coalesce(1)
    S.write_table(df, str(path), "csv", compression="gzip")
    assert len(list(path.glob("*.csv.gz"))) == 4
    assert {int(r.case_id): r.Cycle for r in S.read_cases(spark, str(path)).collect()} == dict(enumerate(texts))
