"""Hash trees against a plain recursive one: nulls, ties, repeated rows, deep and shallow trees, no rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from matlink.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, node string, place long, path string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """Top of the nodes, and each one's (left, right) siblings level by level."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + fanout, len(nodes))) for a in range(0, len(nodes), fanout)]
        for run in runs:
            for k in run:
                for o in owners[k]:
                    paths[o].append(([nodes[j] for j in run if j < k], [nodes[j] for j in run if j > k]))
        nodes, owners = [sha("".join(nodes[j] for j in run)) for run in runs], [sum((owners[j] for j in run), []) for run in runs]
    return nodes[0], paths


def expected(rows, fanout, changed):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = climb([leaf(r) for r in groups[lang]], fanout)
    root, tops = climb([trees[x][0] for x in langs], fanout)
    out = []
    for lang, above in zip(langs, tops, strict=True):
        sub, paths = trees[lang]
        for r, path in zip(groups[lang], paths, strict=True):
            node = leaf(changed(r)) if changed(r) else leaf(r)
            for a, b in (*path, *above):
                node = sha("".join([*a, node, *b]))
            proof = sha("".join("".join(a + b) for a, b in (*path, *above)))
            out.append((r[0], leaf(r), sub, root, proof, node, node == root))
    return out


def rows_of(n):
    rows = [(i * 37 % n, f"s{i % 3}", ["en", "de", None, "", "é"][min(i % 9, 4)], i, f"Text {i} É" if i % 11 else None) for i in range(n)]
    return [*rows, rows[0], rows[0], (None, None, "en", None, ""), (None, None, "en", None, "A"), (5, "x", "alone", 1, "B" * 100_000)]


@pytest.mark.parametrize("n,fanout,depth", [(150, 8, 4), (150, 2, 2), (40, 3, 1)])
def test_proofs(spark, n, fanout, depth):
    rows = rows_of(n)
    table = spark.createDataFrame([(*r, "a", "b", 1, "c") for r in rows], SCHEMA).repartition(3)
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    claimed = F.when(F.col("doc_id") % 3 == 0, merkle.leaf_hash([*values, F.lower("text")]))
    made = merkle.manifest(table, "lang", "doc_id", merkle.leaf_hash([*values, F.col("text")]), claimed, fanout, depth, with_paths=True)
    got = made.rows.collect()
    want = expected(rows, fanout, lambda r: (*r[:4], r[4].lower() if r[4] else r[4]) if r[0] is not None and r[0] % 3 == 0 else None)
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert made.root == want[0][3] and {(r.grp, r.subroot) for r in made.subroots.collect()} >= {("alone", leaf(rows[-1]))}
    assert all(merkle.fold(r.leaf.encode(), merkle.unpack_path(bytes(r.path))).decode() == r.root for r in got)


def test_no_rows(spark):
    table = spark.createDataFrame([], SCHEMA)
    made = merkle.manifest(table, "lang", "doc_id", merkle.leaf_hash([F.col("text")]))
    assert made.root is None and made.rows.count() == 0 and made.subroots.count() == 0


def test_one_row(spark):
    made = merkle.manifest(spark.createDataFrame([(1, None, None, None, None, None, None, None, None)], SCHEMA), "lang", "doc_id", merkle.leaf_hash([F.col("text")]))
    row = made.rows.first()
    assert row.leaf == row.subroot == row.root == row.folded_root == sha("-") and row.verified and row.proof_sha256 == sha("")
