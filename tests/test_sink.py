"""The replacing sink: whole replacements, readers of versions, lost and concurrent writers."""

import uuid

import pytest
from pyspark.sql import functions as F

from matlink.sources.sink import Conflict, ReplacingSink


@pytest.fixture
def sink(spark, tmp_path):
    return ReplacingSink(spark, f"file://{tmp_path}/{uuid.uuid4().hex}")


def rows(spark, *values):
    return spark.createDataFrame(values, "run string, id long, note string")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_parts_are_replaced(spark, sink):
    with pytest.raises(ValueError, match="no complete version"):
        sink.read()
    assert sink.replace(rows(spark, ("a", 1, "x"), ("a", 2, None), ("b/=é", 3, "y")), "run") == 1
    assert sink.replace(rows(spark, ("a", 9, "z")), "run") == 2
    assert got(sink.read()) == [("a", 9, "z"), ("b/=é", 3, "y")] and sink.parts() == ["a", "b/=é"]
    assert got(sink.read(1)) == [("a", 1, "x"), ("a", 2, None), ("b/=é", 3, "y")]
    assert got(sink.read(parts=["a"])) == [("a", 9, "z")]


def test_a_rerun_without_rows_clears_its_part(spark, sink):
    sink.replace(rows(spark, ("a", 1, "x"), ("b", 2, "y")), "run")
    sink.replace(spark.createDataFrame([], "run string, id long, note string"), "run", ["a"])
    assert got(sink.read()) == [("b", 2, "y")]
    with pytest.raises(ValueError, match="other parts"):
        sink.replace(rows(spark, ("c", 1, "x")), "run", ["a"])
    with pytest.raises(Exception, match="without a part"):
        sink.replace(rows(spark, (None, 1, "x")), "run")
    with pytest.raises(ValueError, match="the dataset is"):
        sink.replace(rows(spark, ("a", 1, "x")).withColumn("more", F.lit(1)), "run")
    assert got(sink.read()) == [("b", 2, "y")]


def test_keys_are_deleted_then_inserted(spark, sink):
    old = [("a", i, f"old{i}") for i in range(200)] + [("a", None, "none"), ("a", 7, "again")]
    sink.replace_keys(rows(spark, *old), ["id"], buckets=8)
    assert got(sink.read()) == sorted(old, key=str)
    new = [("b", 7, "new"), ("b", 7, "newer"), ("b", None, "null"), ("b", 500, "added")]
    sink.replace_keys(rows(spark, *new), ["id"], buckets=8)
    assert got(sink.read()) == sorted([r for r in old if r[1] not in (7, None)] + new, key=str)


def test_only_touched_buckets_are_written(spark, sink):
    sink.replace_keys(rows(spark, *(("a", i, "x") for i in range(100))), ["id"], buckets=16)
    before = sink._manifest(None)[1]
    sink.replace_keys(rows(spark, ("b", 3, "y")), ["id"], buckets=16)
    after = sink._manifest(None)[1]
    assert len(before) == 16 and sum(before[p] != after[p] for p in before) == 1


def test_an_unfinished_replacement_is_not_seen(spark, sink):
    sink.replace(rows(spark, ("a", 1, "x")), "run")

    def fail(version, folders, schema):
        raise KeyboardInterrupt

    commit, sink._commit = sink._commit, fail
    with pytest.raises(KeyboardInterrupt):
        sink.replace(rows(spark, ("a", 2, "y")), "run")
    sink._commit = commit
    assert got(sink.read()) == [("a", 1, "x")]
    assert sink.replace(rows(spark, ("a", 3, "z")), "run") == 2
    assert sink.vacuum() == 2 and got(sink.read()) == [("a", 3, "z")] and sink.versions() == [2]


def test_a_manifest_without_its_end_is_not_seen(spark, sink, tmp_path):
    sink.replace(rows(spark, ("a", 1, "x")), "run")
    (next(tmp_path.iterdir()) / "manifest" / "2").mkdir()
    assert sink.versions() == [1] and got(sink.read()) == [("a", 1, "x")]
    with pytest.raises(Conflict):
        sink.replace(rows(spark, ("a", 2, "y")), "run")
    assert sink.vacuum() == 1 and sink.replace(rows(spark, ("a", 2, "y")), "run") == 2 and got(sink.read()) == [("a", 2, "y")]


def test_drop(spark, sink):
    sink.replace(rows(spark, ("a", 1, "x"), ("b", 2, "y")), "run")
    assert sink.drop(["a", "none"]) == 2 and got(sink.read()) == [("b", 2, "y")]
    assert sink.drop(["none"]) == 2
    assert sink.drop(["b"]) == 3 and got(sink.read()) == [] and sink.read().columns == ["run", "id", "note"]
