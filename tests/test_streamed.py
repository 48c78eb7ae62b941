"""Pairs of two arrays are handed on as they are made: no piece of generated code explodes two arrays, which it would hold as all their pairs."""

import re

import pytest
from pyspark.sql import functions as F

from matlink.operators import candidates
from matlink.plans import items


def pieces(df):
    """How many arrays each piece of generated code explodes."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"\*\s?\((\d+)\) Generate", plan)
    return [found.count(i) for i in set(found)], plan.count("Generate ")


@pytest.fixture
def fixed_plan(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("name", ["candidates_block", "decide_pairs", "evidence_rows"])
def test_one_array_a_piece(spark, data, fixed_plan, name):
    many, arrays = pieces(items.QUERIES[name](spark, data))
    assert arrays >= 2 and max(many) == 1


def test_array_pairs_are_streamed(spark, data, fixed_plan):
    rows = spark.range(50).select("id", (F.col("id") % 3).alias("k"))
    assert max(pieces(candidates.array_pairs(rows, ["k"], ["id"], 5))[0]) == 1


@pytest.mark.parametrize("mode", ["CROSS", "WITHIN", "BOTH"])
@pytest.mark.parametrize("chunk", [3, 2000])
def test_block_pairs(spark, mode, chunk):
    """Each pair once, the smaller id first, whatever chunks and orgs its records are in."""
    rows = [(i * 7 % 41, "C" if i % 5 else None, i % 2, None if i == 9 else f"O{i % 3}") for i in range(41)]
    records = spark.createDataFrame(rows, "id long, category string, block int, org string")
    fits = {"CROSS": lambda a, b: a is not None and b is not None and a != b, "WITHIN": lambda a, b: a is not None and a == b, "BOTH": lambda a, b: True}[mode]
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] and b[1] and a[2] == b[2] and a[0] < b[0] and fits(a[3], b[3]))
    assert sorted(tuple(r) for r in candidates.block_pairs(records, mode, chunk=chunk).collect()) == want
    some = candidates.array_pairs(records.where("category is not null"), ["category", "block"], ["id", "org"], chunk)
    got = some.select("a.id", "a.org", F.col("b.id").alias("j"), F.col("b.org").alias("p")).collect()
    assert sorted((r.id, r.j) for r in got) == sorted((a[0], b[0]) for a in rows for b in rows if a[1] and b[1] and a[2] == b[2] and a[0] < b[0])
    org = {r[0]: r[3] for r in rows}
    assert all(r.org == org[r.id] and r.p == org[r.j] for r in got)


def test_evidence_rows(spark, data):
    """As exploding the evidence of each pair."""
    from matlink.operators import kinds
    from matlink.operators.decide import stored_evidence

    k, of, numbers = items._decided(spark, data)
    rows = kinds.listed(k, of.select("x", "y", stored_evidence(F.col("evidence")).alias("evidence")), numbers).select("id_a", "id_b", F.explode("evidence").alias("e"))
    want = rows.select("id_a", "id_b", "e.attr", "e.level", F.col("e.a").alias("value_a"), F.col("e.b").alias("value_b"), "e.status", "e.rule")
    got = items.evidence_rows(spark, data)
    assert got.columns == want.columns and want.count() and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
