"""Runs that finish, fail and are cancelled, and what they leave."""

import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from matlink.operators.lifecycle import Runs, latest_finished, states, synthetic


@pytest.fixture
def runs(spark, tmp_path):
    return Runs(spark, f"file://{tmp_path}/{uuid.uuid4().hex}", ["pairs", "groups"])


@pytest.fixture
def batches(spark):
    return spark.createDataFrame([(1, "A", "INGESTED", True), (2, "B", "INGESTED", False), (3, "A", "UPLOADED", False), (4, "A", "INGESTED", None)], "batch long, org string, status string, is_synthetic boolean")


def rows(spark, n):
    return lambda: spark.range(n).withColumnRenamed("id", "pair")


def test_done_then_failed(spark, runs, batches):
    one, two = runs.create(batches, [1, 2, 1]), runs.create(batches, [1, 4], "BOTH")
    assert runs.status(one) == "QUEUED" and runs.execute(one, [("pairs", rows(spark, 5)), ("groups", rows(spark, 2))]) == "DONE"
    assert runs.execute(one, []) == "DONE"

    def broken():
        raise RuntimeError("no disk")

    assert runs.execute(two, [("pairs", rows(spark, 7)), ("groups", broken)]) == "FAILED"
    assert runs.results["pairs"].read().groupBy("run").count().collect() == [(one, 5)] and runs.results["groups"].read().count() == 2
    found = {r.run: r for r in runs.states().collect()}
    assert (found[two].status, found[two].error, found[two].batches) == ("FAILED", "RuntimeError: no disk", [1, 4]) and found[one].ended >= found[one].started
    assert latest_finished(runs.states()).first().run == one
    assert {r.run: r.synthetic for r in synthetic(runs.states(), batches).collect()} == {one: True, two: True}


def test_cancelled_while_queued(spark, runs, batches):
    run = runs.create(batches, [1, 2])
    runs.cancel(run)
    assert runs.execute(run, [("pairs", rows(spark, 5))]) == "CANCELLED" and runs.results["pairs"].versions() == []
    with pytest.raises(ValueError, match="is CANCELLED"):
        runs.cancel(run)


def test_cancelled_while_running(spark, runs, batches):
    """Its job is ended, and the rows of earlier stages go; those of other runs stay."""
    other, run = runs.create(batches, [1, 2]), runs.create(batches, [1, 2])
    runs.execute(other, [("pairs", rows(spark, 3))])

    @F.udf("long")
    def slow(i):
        time.sleep(0.5)
        return i

    def stuck():
        return spark.range(0, 4000, 1, 4).select(slow("id").alias("pair"))

    ended = []
    worker = threading.Thread(target=lambda: ended.append(runs.execute(run, [("pairs", rows(spark, 9)), ("groups", stuck)])))
    worker.start()
    for _ in range(200):
        if runs.results["pairs"].versions() == [1, 2]:
            break
        time.sleep(0.1)
    time.sleep(2)
    runs.cancel(run)
    worker.join(60)
    assert ended == ["CANCELLED"] and runs.results["pairs"].read().groupBy("run").count().collect() == [(other, 3)]


@pytest.mark.parametrize("ids,mode,said", [([], "CROSS", "at least one"), ([1, 9], "BOTH", "does not exist"), ([1, 3], "BOTH", "ingest these batches first: 3"), ([1, 4], "CROSS", "needs two"), ([1, 2], "ALL", "unknown mode")])
def test_refused(runs, batches, ids, mode, said):
    with pytest.raises(ValueError, match=said):
        runs.create(batches, ids, mode)


def test_fold(spark):
    log = [("a", 1, "QUEUED"), ("a", 2, "RUNNING"), ("b", 1, "QUEUED"), ("c", 1, "QUEUED"), ("c", 3, "DONE"), ("c", 4, "FAILED"), ("c", 2, "CANCEL_ASKED"), ("a", 9, "CANCEL_ASKED")]
    table = spark.createDataFrame([(r, s, x, None, None, None, None) for r, s, x in log], "run string, seq long, status string, error string, mode string, batches array<long>, at timestamp")
    assert {r.run: r.status for r in states(table).collect()} == {"a": "RUNNING", "b": "QUEUED", "c": "DONE"}
    assert states(table.limit(0)).count() == 0 and latest_finished(states(table.limit(0))).count() == 0
