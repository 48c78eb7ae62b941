"""Candidate channels against brute force."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from matlink.operators import candidates as C


@pytest.mark.parametrize("mode", ["CROSS", "WITHIN", "BOTH"])
def test_chunks_of_a_block(spark, mode):
    rows = [(i, str(i % 3), "PIPE" if i % 10 else None, ["100", "100", "80", None][i % 4]) for i in range(90)]
    right = {"CROSS": lambda a, b: a != b, "WITHIN": lambda a, b: a == b, "BOTH": lambda a, b: True}[mode]
    want = sorted((a[0], b[0]) for a, b in combinations(rows, 2) if a[2] and a[3] and a[2:] == b[2:] and right(a[1], b[1]))
    records = spark.createDataFrame(rows, "id long, org string, category string, block string")
    for chunk in (1, 7, 1000):
        assert sorted(map(tuple, C.block_pairs(records, mode, chunk=chunk).collect())) == want


def test_large_blocks_keep_their_pairs(spark):
    records = spark.range(2400).select("id", (F.col("id") % 3).cast("string").alias("org"), F.lit("PIPE").alias("category"), F.lit("100").alias("block"))
    assert C.block_pairs(records).count() == 3 * 800 * 800
    assert C.block_pairs(records, cap=2000).count() == 0 and C.unblocked(records, 2000).count() == 2400


@pytest.mark.parametrize("cell,pivots", [(2000, 64), (15, 8), (7, 3), (40, 1)])
def test_dense_neighbours(spark, cell, pivots):
    """Clusters far apart, copies, ties and a category of one, in many cells and in one."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, "ab"[i % 2], (centres[i % 6] + rng.normal(size=8) * (0.05 if i % 3 else 1)).tolist()) for i in range(180)]
    rows += [(200 + i, "a", rows[0][2]) for i in range(30)] + [(400, "one", [1.0] * 8), (401, None, [1.0] * 8), (402, "a", None)]
    got = {}
    for r in C.dense_neighbours(spark.createDataFrame(rows, "id long, category string, vector array<double>"), k=5, cell=cell, pivots=pivots).collect():
        got.setdefault(r.id_a, []).append((r.rank, r.id_b, r.score))
    unit = {i: np.array(v) / np.sqrt(sum(x * x for x in v)) for i, c, v in rows if c and v}
    for i, c, v in rows:
        near = sorted((-round(float(unit[i] @ unit[j]), 5), j) for j, d, w in rows if d == c and w and j != i)[:5] if c and v else []
        assert [(b, s) for _, b, s in sorted(got.get(i, []))] == [(j, pytest.approx(-s, abs=1.01e-5)) for s, j in near], i


@pytest.mark.parametrize("mode", ["CROSS", "WITHIN", "BOTH"])
def test_lexical_neighbours_fill_up(spark, mode):
    """Records without a shared token rank by id, whatever org the lowest ids are of."""
    words = ["valve gate", "pipe steel", "valve", "bolt", ""]
    rows = [(i, "A" if i < 25 else "BCD"[i % 3], "x" if i % 10 else "y", words[i % 5].split()) for i in range(70)]
    table = spark.createDataFrame(rows, "id long, org string, category string, tokens array<string>")
    queries = table.where("id % 7 = 0")
    got = {}
    for r in C.lexical_neighbours(table, queries, k=6, mode=mode).collect():
        got.setdefault(r.id_a, []).append((r.rank, r.id_b, r.score))
    scores = {(r["query"], r["id"]): round(r["score"], 9) for r in C.bm25_scores(table, queries).collect()}
    right = {"CROSS": lambda a, b: a != b, "WITHIN": lambda a, b: a == b, "BOTH": lambda a, b: True}[mode]
    for i, org, category, _ in rows:
        if i % 7 == 0:
            best = sorted((-scores.get((i, j), 0.0), j) for j, o, c, _ in rows if c == category and j != i and right(org, o))[:6]
            assert [(b, s) for _, b, s in sorted(got.get(i, []))] == [(j, pytest.approx(-s)) for s, j in best], i
