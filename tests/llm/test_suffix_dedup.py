"""Suffix arrays, common prefixes and the whole operator against plain ones."""

from collections import Counter

import numpy as np
import pytest

from matlink.llm import suffix_dedup
from matlink.llm.suffix_dedup import dedup_suffixes

SCHEMA = "doc_id long, text string, source string, id string, hit int, doc int, kept string, low int"
RNG = np.random.default_rng(7)
PASSAGE = "".join(map(chr, RNG.integers(97, 123, 300)))


def noise(n, letters=26):
    return "".join(map(chr, RNG.integers(97, 97 + letters, n)))


@pytest.mark.parametrize("n,letters,depth", [(300, 2, 20), (2000, 3, 7), (700, 1, 50), (1, 2, 5), (3000, 26, 400), (500, 2, 1)])
def test_suffixes(n, letters, depth):
    s = RNG.integers(97, 97 + letters, n).astype(np.uint8)
    if n == 3000:
        s[1500:2700] = s[100:1300]
    data = s.tobytes()
    order = suffix_dedup.suffix_array(s, depth)
    heads = [data[i : i + depth] for i in order]
    assert heads == sorted(heads) and sorted(order) == list(range(n))

    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    assert suffix_dedup.common_prefixes(s, order, depth).tolist() == [0, *(common(a, b) for a, b in zip(heads, heads[1:], strict=False))]


def plain(rows, window):
    """(n_bytes, spans, kept) of each text."""
    texts = [(t or "").encode() for t in rows]
    seen = Counter(b[i : i + window] for b in texts for i in range(len(b) - window + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i + 1 : i + window + 1] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1])
        out.append((len(b), list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)))
    return out


def texts():
    long = noise(40_000)
    rows = [noise(500) + PASSAGE + noise(100), PASSAGE + noise(30), noise(77) + PASSAGE[:250], PASSAGE[40:] + PASSAGE[:260], noise(90), None, "", " ", "a" * 700, "ab" * 400, "né €" * 60]
    rows += [long, noise(10) + long[1000:39_000] + noise(5), long[500:900], noise(2000, 2)] + [noise(20) + PASSAGE + noise(20) for _ in range(60)]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("window,shard", [(60, 3 << 20), (60, 2000), (9, 3000), (200, 1), (1, 3 << 20)])
def test_awkward_texts(spark, window, shard):
    rows = texts() if window > 1 else texts()[:6]
    table = spark.createDataFrame([(i, t, "s", "x", 1, 2, "k", 3) for i, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: r for r in dedup_suffixes(table, window=window, shard=shard).collect()}
    for (i, _), (n, spans, kept) in zip(rows, plain([t for _, t in rows], window), strict=True):
        r = got[i]
        assert (r.n_bytes, r.n_removed, [(x.start, x.end) for x in r.removed], bytes(r.kept)) == (n, n - len(kept), spans, kept), i
        assert (r.source, r.id, r.hit, r.doc, r.low) == ("s", "x", 1, 2, 3)
    assert len(got) == len(rows)


def test_repeated_rows_and_null_ids(spark):
    one, other = noise(500), noise(500)
    rows = [(1, one), (1, one), (None, other), (None, other), (None, noise(500)), (2, other[:100] + noise(50)), (2, noise(30) + other[200:300]), (3, noise(300))]
    table = spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in rows], SCHEMA)
    got = sorted((r.n_bytes, r.n_removed) for r in dedup_suffixes(table, window=60).collect())
    assert got == sorted((n, n - len(kept)) for n, _, kept in plain([t for _, t in rows], 60))


def test_no_rows(spark):
    assert dedup_suffixes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_split_keys_are_merged():
    kind = suffix_dedup._Split.KIND
    shards = [np.array([(1, 10, 0, False), (2, 11, 0, False), (3, 12, 0, True)], kind), np.array([(2, 20, 5, False), (4, 21, 0, False)], kind), np.array([(3, 30, 0, False), (5, 31, 0, False)], kind)]
    found = suffix_dedup._Split.merge([s.tobytes() for s in shards])
    assert sorted(found["row"].tolist()) == [11, 12, 20, 30]
