"""The registered queries, each called as it is registered: against SQL, brute force or held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from matlink.llm import packing
from matlink.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, data, name):
    result = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    want = sorted(result.fetchall(), key=str)
    got = QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == want


def test_op1(spark, data, texts):
    encode = packing._Encoder(packing.public_files()[0], None)
    ids = {i: np.append(encode(t).astype("<u4"), np.uint32(1)) for i, t in texts.items()}
    rows = QUERIES["op1_packing"](spark, data).toPandas()
    for doc, part in rows.sort_values("start").groupby("doc_id"):
        assert part["start"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() == len(ids[doc]) and (part["doc_tokens"] == len(ids[doc])).all()
        assert [zlib.crc32(ids[doc][a : a + n].astype("<u4").tobytes()) for a, n in zip(part["start"], part["length"], strict=True)] == part["ids_crc32"].tolist()
    assert set(rows["doc_id"]) == set(ids)
    for _, part in rows.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() <= 2048


def test_op3(spark, data, texts):
    rows = {r.doc_id: r for r in QUERIES["op3_simhash_fingerprints"](spark, data).collect()}
    order = sorted(texts, reverse=True)
    same = {}
    for at, i in enumerate(order):
        text, after = texts[i], texts[order[(at + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
        assert same.setdefault(text, rows[i].fingerprint) == rows[i].fingerprint
    assert np.mean([r.near_edited for r in rows.values()]) > np.mean([r.near_next for r in rows.values()]) + 0.1


def test_op6(spark, data, texts):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [None] for i, t in texts.items()}
    counts = Counter(w for i in texts if not held[i] for w in words[i])
    n, v = sum(counts.values()), len(counts)
    rows = QUERIES["op6_hmm_score"](spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_op5_and_op7(spark, data, texts):
    kept = QUERIES["op5_quality_perplexity"](spark, data).toPandas()
    assert sorted(kept["doc_id"]) == sorted(texts) and (kept["perplexity"] >= 1).all() and (kept["keep"] == (kept["perplexity"] <= kept["threshold"])).all()
    pages = QUERIES["op7_html_main_text"](spark, data).toPandas()
    assert (pages["n_chars"] == pages["text"].str.len()).all() and not pages["text"].str.contains(r"\s\s|<script|^\s|\s$").any()
    assert len(pages) == len(pd.read_parquet(f"{data}/pages.parquet"))


def test_op10(spark, data):
    rows = QUERIES["op10_language_id"](spark, data).toPandas()
    docs = pd.read_parquet(f"{data}/documents.parquet")[["doc_id", "lang", "text"]]
    both = rows.merge(docs, on="doc_id")
    assert len(both) == len(docs) and both["score"].between(0, 1).all()
    assert (both["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both["doc_id"]]).all()
    unseen = both[both["held_out"] & both["lang"].notna() & both["text"].fillna("").str.contains(r"[^\W\d_]")]
    assert (unseen["lang"] == unseen["lang_pred"]).mean() > 0.9
