"""Runs and their states: an append-only log of events, folded to a state a run, and results that come and go with it.

A run writes its results to replacing sinks, one part a run. It can be cancelled from another thread or
session: the wish is an event, jobs of the run carry its tag and are cancelled, and what it has written goes.
"""

from __future__ import annotations

import datetime
import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matlink.sources.sink import ReplacingSink

TERMINAL = ("DONE", "CANCELLED", "FAILED")
MODES = ("CROSS", "WITHIN", "BOTH")
_EVENT = "run string, seq long, status string, error string, mode string, batches array<long>, at timestamp"


def states(events: DataFrame) -> DataFrame:
    """(run, status, error, mode, batches, started, ended) of events (run, seq, status, error, mode, batches, at).

    The first terminal event decides; before it, the last one. Wishes to cancel aren't states.
    mode and batches are those of the first event.
    """
    seen = events.where("status <> 'CANCEL_ASKED'")
    final = F.col("status").isin(*TERMINAL)
    own = F.struct("status", "error", "at")
    folded = seen.groupBy("run").agg(F.min_by(F.when(final, own), F.when(final, F.col("seq"))).alias("end"), F.max_by(own, "seq").alias("now"), F.min_by("mode", "seq").alias("mode"), F.min_by("batches", "seq").alias("batches"), F.min("at").alias("started"))
    last = F.coalesce("end", "now")
    return folded.select("run", last["status"].alias("status"), last["error"].alias("error"), "mode", "batches", "started", F.col("end.at").alias("ended"))


def latest_finished(runs: DataFrame) -> DataFrame:
    """The run with status DONE that started last; of equal ones the largest."""
    return runs.where("status = 'DONE'").orderBy(F.desc("started"), F.desc("run")).limit(1)


def synthetic(runs: DataFrame, batches: DataFrame) -> DataFrame:
    """(run, synthetic): does any of a run's batches hold synthetic rows; false for runs without known batches.

    runs: run, batches (array). batches: batch, is_synthetic.
    """
    of = runs.select("run", F.explode("batches").alias("batch")).join(batches.select("batch", "is_synthetic"), "batch")
    flags = of.groupBy("run").agg(F.bool_or("is_synthetic").alias("synthetic"))
    return runs.select("run").join(flags, "run", "left").select("run", F.coalesce("synthetic", F.lit(False)).alias("synthetic"))


class Cancelled(Exception):
    """The run was cancelled between two stages."""


class Runs:
    """Runs under path: events, and a replacing sink for each named result."""

    def __init__(self, spark: SparkSession, path: str, results: Sequence[str]):
        self.spark, self.path = spark, path.rstrip("/")
        self.results = {name: ReplacingSink(spark, f"{self.path}/results/{name}") for name in results}

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _event(self, run: str, status: str, error: str | None = None, mode: str | None = None, batches: list[int] | None = None) -> None:
        """A small file an event, written by the driver: a run that holds every core can still be cancelled."""
        seq = time.time_ns()
        at = datetime.datetime.fromtimestamp(seq // 1000 / 1e6, datetime.UTC).isoformat()
        fs, where = self._files(f"{self.path}/events/{run}/{seq}.json")
        out = fs.create(where, False)
        try:
            out.write(bytearray(json.dumps({"run": run, "seq": seq, "status": status, "error": error, "mode": mode, "batches": batches, "at": at}).encode()))
        finally:
            out.close()

    def events(self) -> DataFrame:
        return self.spark.read.schema(_EVENT).json(f"{self.path}/events/*")

    def states(self) -> DataFrame:
        return states(self.events())

    def _own(self, run: str) -> list[str]:
        """A run's states in order, and its wishes to cancel; a handful of files."""
        fs, where = self._files(f"{self.path}/events/{run}/*.json")
        found = []
        for path in sorted((f.getPath() for f in fs.globStatus(where) or []), key=lambda p: int(p.getName().removesuffix(".json"))):
            stream = fs.open(path)
            try:
                found.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["status"])
            finally:
                stream.close()
        return found

    def status(self, run: str) -> str:
        seen = [s for s in self._own(run) if s != "CANCEL_ASKED"]
        if not seen:
            raise KeyError(f"no run {run}")
        return next((s for s in seen if s in TERMINAL), seen[-1])

    def create(self, batches: DataFrame, ids: Sequence[int], mode: str = "CROSS") -> str:
        """A queued run over batches (batch, org, status) of these ids; ValueError says what is wrong with them."""
        ids = list(dict.fromkeys(ids))
        if not ids:
            raise ValueError("choose at least one batch")
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode}")
        found = batches.where(F.col("batch").isin(ids)).select("batch", "org", "status").collect()
        if len({r.batch for r in found}) != len(ids):
            raise ValueError("one of the batches does not exist")
        if pending := sorted(r.batch for r in found if r.status != "INGESTED"):
            raise ValueError(f"ingest these batches first: {', '.join(map(str, pending))}")
        if mode == "CROSS" and len({r.org for r in found}) < 2:
            raise ValueError("a run across organisations needs two of them")
        run = uuid.uuid4().hex
        self._event(run, "QUEUED", mode=mode, batches=ids)
        return run

    @staticmethod
    def _tag(run: str) -> str:
        return f"run-{run}"

    def cancel(self, run: str) -> None:
        """Asks a run to stop. A queued one is cancelled at once; a running one loses its jobs and clears up itself."""
        status = self.status(run)
        if status in TERMINAL:
            raise ValueError(f"run {run} is {status}")
        self._event(run, "CANCEL_ASKED")
        if status == "QUEUED":
            self._event(run, "CANCELLED")
        else:
            self.spark.sparkContext.cancelJobsWithTag(self._tag(run))

    def _asked(self, run: str) -> bool:
        return "CANCEL_ASKED" in self._own(run)

    def clear(self, run: str) -> None:
        """Removes what a run has written from every result."""
        for sink in self.results.values():
            if sink.versions():
                sink.drop([run])

    def execute(self, run: str, stages: Sequence[tuple[str, Callable[[], DataFrame]]]) -> str:
        """Runs stages (result, function) in order, each written to its result; the state it ends in.

        A failure or a cancellation leaves no rows of the run, and doesn't raise. A run that isn't queued is left alone.
        """
        if self.status(run) != "QUEUED":
            return self.status(run)
        self._event(run, "RUNNING")
        context, error, end = self.spark.sparkContext, None, "DONE"
        context.addJobTag(self._tag(run))
        try:
            for name, make in stages:
                if self._asked(run):
                    raise Cancelled(name)
                rows = make()
                self.results[name].replace(rows.withColumn("run", F.lit(run)), "run", [run])
            if self._asked(run):
                raise Cancelled("end")
        except Exception as e:
            context.removeJobTag(self._tag(run))
            end, error = ("CANCELLED", None) if isinstance(e, Cancelled) or self._asked(run) else ("FAILED", f"{type(e).__name__}: {str(e)[:500]}")
            self.clear(run)
        finally:
            context.removeJobTag(self._tag(run))
        self._event(run, end, error)
        return end
