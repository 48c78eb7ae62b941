"""Review state, consent, notices, and a hash-chained audit log."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "GENESIS"
#: state -> action -> next state. Fixed values.
TRANSITIONS = {
    "OPEN": {"PROPOSE": "MADE"},
    "MADE": {"APPROVE": "DONE", "ASK": "AWAITING_CONSENT", "OVERTURN": "OPEN"},
    "AWAITING_CONSENT": {"CONSENT": "DONE", "OVERTURN": "OPEN"},
    "DONE": {},
}


def next_state(state: Column, action: Column) -> Column:
    """The state after an action; an action that a state doesn't know changes nothing."""
    out = state
    for here, moves in TRANSITIONS.items():
        for name, there in moves.items():
            out = F.when((state == here) & (action == name), there).otherwise(out)
    return out


def review_states(log: DataFrame) -> DataFrame:
    """(task, state, steps) after all of log (task, pos, action), in order of pos."""
    ordered = log.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("pos", "action"))).alias("log"))
    state = F.aggregate("log", F.lit("OPEN"), lambda s, e: next_state(s, e["action"]))
    return ordered.select("task", state.alias("state"), F.size("log").cast("long").alias("steps"))


def missing_consents(participants: DataFrame, answers: DataFrame) -> DataFrame:
    """(cluster, org) that haven't answered."""
    return participants.select("cluster", "org").distinct().join(answers, ["cluster", "org"], "left_anti")


def notices(crosswalk: DataFrame) -> DataFrame:
    """Per org and code, the ordered delta of its records."""
    return crosswalk.groupBy("org", "code").agg(F.array_sort(F.collect_list(F.struct("legacy_code", "action"))).alias("delta"), F.count("*").alias("records"))


def link(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, payload), 256)


def chain(log: DataFrame) -> DataFrame:
    """log (chain, id, payload) with prev and hash: each row's hash covers that of the row before.

    A chain is a sequential fold, so it is one task's group; a log is cut into chains of
    bounded length by its caller.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        before, prev, own = GENESIS, [], []
        for payload in frame["payload"]:
            prev.append(before)
            before = hashlib.sha256((before + payload).encode()).hexdigest()
            own.append(before)
        return frame.assign(prev=prev, hash=own)[["chain", "id", "payload", "prev", "hash"]]

    return log.groupBy("chain").applyInPandas(fold, "chain long, id long, payload string, prev string, hash string")


def verify(log: DataFrame) -> DataFrame:
    """(chain, rows, first_bad): the first row whose link or hash fails, or null. Rows are checked in parallel."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("chain").orderBy("id")), F.lit(GENESIS))
    bad = (F.col("prev") != F.col("before")) | (F.col("hash") != link(F.col("prev"), F.col("payload")))
    return log.withColumn("before", before).groupBy("chain").agg(F.count("*").alias("rows"), F.min(F.when(bad, F.col("id"))).alias("first_bad"))


def page(log: DataFrame, before: int | None, limit: int) -> DataFrame:
    """Newest rows first, below id before (keyset paging); at most 500."""
    rows = log if before is None else log.where(F.col("id") < before)
    return rows.orderBy(F.desc("id")).limit(min(limit, 500))


def hides_secrets(keys: Column) -> Column:
    """True where an audit difference has keys that may not be stored."""
    return F.arrays_overlap(F.transform(keys, F.lower), F.array(*map(F.lit, ("password", "password_hash", "token", "secret", "api_key", "vendor_salt"))))
