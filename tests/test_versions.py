import threading

import pytest
from pyspark.sql import functions as F

from caseloom.sources import runs as R
from caseloom.sources import versions as V


def text(path):
    return open(f"{path}/x").read()


def writer(content):
    def write(path):
        import os

        os.makedirs(path)
        with open(f"{path}/x", "w") as file:
            file.write(content)

    return write


def test_a_stopped_writer_leaves_the_former_version(tmp_path):
    folder = str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        V.current(folder)
    V.publish(folder, writer("one"))

    def stops(path):
        writer("half")(path)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        V.publish(folder, stops)
    assert text(V.current(folder)) == "one"
    V.publish(folder, writer("two"))
    assert text(V.current(folder)) == "two"


def test_the_last_versions_are_kept(tmp_path):
    folder = f"file://{tmp_path}/m"
    paths = [V.publish(folder, lambda p, i=i: writer(str(i))(p.removeprefix("file://")), keep=2) for i in range(5)]
    kept = [n for n in V._names(folder) if n.startswith("version-")]
    assert [p.rpartition("/")[2] for p in paths[-2:]] == kept
    assert V.current(folder) == paths[-1]


def test_two_writers_cannot_make_the_same_manifest(tmp_path):
    folder = str(tmp_path / "m")
    V.publish(folder, writer("one"))
    with pytest.raises(FileExistsError):
        V._switch(folder, {}, 1)
    assert text(V.current(folder)) == "one"


def test_a_model_is_replaced_when_the_new_one_is_whole(spark, tmp_path):
    class Model:
        def __init__(self, fails):
            self.fails = fails

        def write(self):
            return self

        def save(self, path):
            writer("new")(path)
            if self.fails:
                raise OSError("disk full")

    good = R.save_best(Model(False), str(tmp_path))
    with pytest.raises(OSError):
        R.save_best(Model(True), str(tmp_path))
    assert V.current(f"{tmp_path}/best_model") == good
    assert R.save_best(Model(False), str(tmp_path)) != good


def rows(spark, *data):
    return spark.createDataFrame(data, "run_id string, epoch int, loss double, attempt int")


def test_the_same_append_twice_counts_once(spark, tmp_path):
    store = V.KeyedAppends(spark, str(tmp_path / "h"))
    with pytest.raises(FileNotFoundError):
        store.read()
    part = rows(spark, ("007", 1, 0.5, 1), ("007", 2, 0.4, 1), (None, 1, 0.1, 1))
    for _ in range(3):
        store.append(part)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, part.collect()))
    store.append(rows(spark, ("007", 2, None, 1)))
    assert store.read().where("run_id = '007' AND epoch = 2").first().loss is None


def test_the_highest_attempt_counts_whatever_the_order(spark, tmp_path):
    store = V.KeyedAppends(spark, str(tmp_path / "h"), attempt="attempt")
    store.append(rows(spark, ("a", 1, 0.2, 2)))
    store.append(rows(spark, ("a", 1, 0.9, 1)))
    assert store.read().first().loss == 0.2
    store.compact()
    store.append(rows(spark, ("a", 1, 0.8, 1)))
    assert [tuple(r) for r in store.read().collect()] == [("a", 1, 0.2, 2)]


def test_compaction_bounds_the_folders_and_loses_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "h")
    store = V.KeyedAppends(spark, folder)
    for i in range(6):
        store.append(rows(spark, ("r", i, float(i), 1)))
        if i % 2:
            store.compact(parts=1)
        assert store.files() <= 2 and store.read().count() == i + 1
    # an append that arrives between the listing and the manifest
    late, switch = rows(spark, ("late", 1, 1.0, 1)), V._switch
    store.append(rows(spark, ("r", 9, 9.0, 1)))

    def meanwhile(*args):
        store.append(late)
        switch(*args)

    monkeypatch.setattr(V, "_switch", meanwhile)
    store.compact()
    assert store.files() == 2 and {r.run_id for r in store.read().collect()} == {"r", "late"} and store.read().count() == 8
    # folders of replaced appends go with the next compaction
    monkeypatch.setattr(V, "_switch", switch)
    store.compact()
    assert len([n for n in V._names(folder) if n.startswith("append-")]) <= 2


def test_an_unfinished_append_is_not_read(spark, tmp_path):
    store = V.KeyedAppends(spark, str(tmp_path / "h"))
    store.append(rows(spark, ("a", 1, 1.0, 1)))
    rows(spark, ("b", 1, 1.0, 1)).withColumn(V.COMMIT, F.lit("x")).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).parquet(f"{tmp_path}/h/append-99999999999999999999-half")
    assert [r.run_id for r in store.read().collect()] == ["a"]


def test_appends_at_the_same_time(spark, tmp_path):
    store = V.KeyedAppends(spark, str(tmp_path / "h"))
    threads = [threading.Thread(target=lambda i=i: store.append(rows(spark, (f"r{i}", 1, 1.0, 1)))) for i in range(6)]
    for t in threads:
        t.start()
    store_errors = [t.join() for t in threads]
    assert store_errors == [None] * 6 and store.read().count() == 6
    R.compact_history(spark, str(tmp_path / "h"))
    assert R.read_history(spark, str(tmp_path / "h")).count() == 6
