"""Tables that several writers add to."""

import threading

import pytest
from pyspark.sql import functions as F

from lectern import storage, tables

SCHEMA = "id string, status string, n int"


def table(spark, tmp_path):
    return tables.Table(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema)


def rows(t, number=None):
    return sorted(map(tuple, t.read(number).collect()), key=str)


def make(spark, *values):
    return spark.createDataFrame(values, SCHEMA)


def test_put_if_absent(spark, tmp_path):
    path = str(tmp_path / "a" / "v")
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if storage.put_if_absent(spark, path, f"text {k}") else None) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and (tmp_path / "a" / "v").read_text() == f"text {won[0]}"
    assert [p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith(".")] == ["v"]
    assert storage.put_if_absent(spark, f"file://{tmp_path}/b c", "x") and (tmp_path / "b c").read_text() == "x"


def test_ids_are_added_once(spark, tmp_path):
    t = table(spark, tmp_path)
    assert rows(t) == [] and t.version().number == 0
    assert t.append(make(spark, ("a", "new", 1), ("a", "other", 2), (None, "x", 3), ("b", None, None))) == 1
    assert rows(t) == [("a", "new", 1), ("b", None, None)]
    assert t.append(make(spark, ("a", "later", 9), ("c", "new", 3))) == 2
    assert rows(t) == [("a", "new", 1), ("b", None, None), ("c", "new", 3)] and len(rows(t, 1)) == 2


def test_a_failed_job_leaves_the_version(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(make(spark, ("a", "new", 1)))
    broken = make(spark, ("c", "x", 2)).withColumn("status", F.raise_error(F.lit("no")).cast("string"))
    for add in (t.append, t.change):
        with pytest.raises(Exception, match="no"):
            add(broken)
    assert rows(t) == [("a", "new", 1)] and t.version().number == 1
    t.sweep()
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_a_writer_that_comes_second(spark, tmp_path, monkeypatch):
    """Another writer commits between the reading and the commit of this one."""
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    real, met = tables.put_if_absent, []

    def raced(session, path, text):
        if not met:
            met.append(1)
            other.append(make(spark, ("a", "theirs", 1), ("z", "theirs", 2)))
        return real(session, path, text)

    monkeypatch.setattr(tables, "put_if_absent", raced)
    assert t.append(make(spark, ("a", "mine", 5), ("b", "mine", 6))) == 2
    assert rows(t) == [("a", "theirs", 1), ("b", "mine", 6), ("z", "theirs", 2)]


def test_writers_at_once(spark, tmp_path):
    t, failed = table(spark, tmp_path), []

    def add(k):
        try:
            table(spark, tmp_path).append(make(spark, *[(f"id{j}", f"w{k}", j) for j in range(k, k + 6)]))
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failed and t.version().number == 4
    assert [r[0] for r in rows(t)] == sorted(f"id{j}" for j in range(9))


def test_changes_are_merged_when_read(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(make(spark, ("a", "new", 1), ("b", "new", 2)))
    t.change(spark.createDataFrame([("a", "done"), ("q", "waits")], "id string, status string"))
    t.change(spark.createDataFrame([("a", None, 7), ("b", "x", None), (None, "y", 1)], SCHEMA))
    want = [("a", "done", 7), ("b", "x", 2)]
    assert rows(t) == want
    t.append(make(spark, ("q", "new", 3)))
    want.append(("q", "waits", 3))
    assert rows(t) == want
    t.change(spark.createDataFrame([("z", "waits too")], "id string, status string"))
    t.compact()
    assert rows(t) == want and len(t.version().changes) == 1 and len(t.version().rows) == 1
    t.change(spark.createDataFrame([("b", "last")], "id string, status string"))
    t.append(make(spark, ("z", "new", 4)))
    t.sweep()
    assert rows(t) == [("a", "done", 7), ("b", "last", 2), ("q", "waits", 3), ("z", "waits too", 4)]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 4 and len(t._names()) == 1


def test_compacting_keeps_what_comes_in_meanwhile(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.append(make(spark, ("a", "new", 1)))
    t.change(spark.createDataFrame([("a", "done")], "id string, status string"))
    real, met = t._new_folder, []

    def slow(data):
        made = real(data)
        if not met:
            met.append(1)
            other = table(spark, tmp_path)
            other.append(make(spark, ("b", "new", 2)))
            other.change(spark.createDataFrame([("a", 9)], "id string, n int"))
        return made

    monkeypatch.setattr(t, "_new_folder", slow)
    t.compact()
    assert rows(t) == [("a", "done", 9), ("b", "new", 2)] and len(t.version().changes) == 2
