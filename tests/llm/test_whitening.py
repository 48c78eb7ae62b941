"""Whitening against numpy: dropped rows, repeated vectors, exact deviations, little or no variance."""

import numpy as np
import pytest

from matlink.llm import whitening
from matlink.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, x string, v int, id long"


def fit_of(x):
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.astype(object).sum(axis=0)
    centred = ((n * fit.astype(object) - sums).astype(float)) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, centred, values[::-1], vectors[:, ::-1]


def check(made, ids, x, components):
    n, sums, centred, values, vectors = fit_of(x)
    assert (made.n, made.sums) == (n, [int(s) for s in sums])
    keep = values[:components][values[:components] > values[0] * 1e-10]
    assert made.eigenvalues == pytest.approx(keep, rel=1e-9) and made.total == pytest.approx(values.sum(), rel=1e-9) and made.identity_error < 1e-6
    signs = np.sign((made.components * vectors[:, : len(keep)]).sum(axis=0))
    assert abs(made.components - signs * vectors[:, : len(keep)]).max() < 1e-8
    want = []
    for i, row in zip(ids, x, strict=True):
        d = [n * int(a) - int(s) for a, s in zip(row, sums, strict=True)]
        want.append((str(i), sum(v * v for v in d), (np.array(d, float) / n @ (signs * vectors[:, : len(keep)]) / np.sqrt(keep)).tolist()))
    got = sorted((str(r.vec_id), int(r.deviation), r.whitened) for r in made.rows.collect())
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    assert np.abs(np.array([g[2] for g in got]) - np.array([w[2] for w in sorted(want)])).max() < 1e-7


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    kept = [(i, (rng.normal(size=6) * [1, 2, 3, 4, 5, 6]).tolist()) for i in range(80)]
    kept += [(100 + i, kept[0][1]) for i in range(40)] + [(5, kept[6][1]), (None, kept[7][1]), (2**60 + 1, kept[8][1])]
    gone = [(900, None), (901, []), (902, [1.0] * 5 + [None]), (903, [NAN] * 6), (904, [INF] + [0.0] * 5), (905, [-INF] + [0.0] * 5), (906, [1.0] * 5), (907, [1.0] * 7)]
    table = spark.createDataFrame([(i, e, "a", 1, 2) for i, e in kept + gone], SCHEMA).repartition(3)
    x = np.floor(64 * np.array([e for _, e in kept])).astype(np.int64) + 1_000_000
    check(whitening.whiten(table, "vec_id", "embedding", components=4), [i for i, _ in kept], x, 4)


def test_large_entries_and_lost_dimensions(spark):
    """Products beyond 64 bits stay exact; a constant dimension and a sum of others have no component."""
    rng = np.random.default_rng(4)
    a = rng.integers(-(10**13), 10**13, (50, 2)).astype(float)
    rows = [(i, [p, q, p + q, 7.0]) for i, (p, q) in enumerate(a.tolist())]
    table = spark.createDataFrame([(i, e, "a", 1, 2) for i, e in rows], SCHEMA)
    made = whitening.whiten(table, "vec_id", "embedding", scale=1)
    assert len(made.eigenvalues) == 2 and made.identity_error < 1e-4
    x = np.array([e for _, e in rows]).astype(np.int64) + 1_000_000
    n, sums, *_ = fit_of(x)
    for r in made.rows.collect():
        assert int(r.deviation) == sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[r.vec_id], sums, strict=True))


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_no_variance(spark, rows):
    made = whitening.whiten(spark.createDataFrame([(i, e, "a", 1, 2) for i, e in rows], SCHEMA), "vec_id", "embedding")
    got = made.rows.collect()
    assert len(got) == sum(e is not None for _, e in rows) and all(r.whitened == [] and int(r.deviation) == 0 for r in got)
    assert made.total == 0 and len(made.eigenvalues) == 0


def test_query(spark, data):
    rows = QUERIES["op11_embedding_whitening"](spark, data).toPandas()
    given = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.stack(given["embedding"]).astype(float)).astype(np.int64) + 1_000_000
    n, sums, _, values, vectors = fit_of(x)
    assert (rows["n"] == n).all() and len(rows) == 16 * len(given) and (rows["identity_error"] < 1e-4).all()
    wide = rows.pivot(index="vec_id", columns="component", values="whitened").loc[given["vec_id"]].to_numpy()
    want = (n * x - sums.astype(np.int64)) / n @ vectors[:, :16] / np.sqrt(values[:16])
    assert np.abs(wide * np.sign(wide[0]) - want * np.sign(want[0])).max() < 1e-8
    assert rows.groupby("component")["explained"].first().to_numpy() == pytest.approx(values[:16] / values.sum(), rel=1e-6)
    deviation = {i: sum((n * int(v) - int(s)) ** 2 for v, s in zip(r, sums, strict=True)) for i, r in zip(given["vec_id"], x, strict=True)}
    assert (rows["deviation"] == rows["vec_id"].map(deviation)).all()
