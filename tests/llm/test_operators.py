"""The training-data operators against brute force on small and awkward tables."""

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from matlink.llm import decontaminate, hmm, html_text, kneser_ney, language_id, ngram_join, packing, simhash, substring_dedup, warc

BASE = [f"w{i * 7919 % 1000}" for i in range(400)]
PASSAGE = " ".join(f"p{i}" for i in range(60))


def edited(words, at):
    return [f"x{at}" if i == at else w for i, w in enumerate(words)]


#: Nulls, empty and very long texts, ties, repeated rows, near copies, shared passages.
TEXTS = [
    (1, " ".join(BASE)), (2, " ".join(BASE)), (3, " ".join(edited(BASE, 10))), (4, " ".join(edited(edited(BASE, 10), 390))), (5, "  "), (6, None), (7, "a b"), (8, "A  b"),
    (9, PASSAGE + " alone here"), (10, "before it " + PASSAGE), (11, "né " * 50), (12, " ".join(f"q{i % 977}" for i in range(30_000))), (12, " ".join(f"q{i % 977}" for i in range(30_000))), (None, "no id " + PASSAGE),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "kept", 0) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_join(docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(docs, words=4, percent=85)[0].collect()}
    sets = {}
    for i, t in TEXTS:
        w = spaced(lower(t))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())
    group = {i: i for i in sets}
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            new, old = sorted((group[a], group[b]), key=lambda x: (x is None, x))
            group = {k: new if v == old else v for k, v in group.items()}
    assert got == {i: (len(sets[i]), group[i]) for i in sets}
    assert ngram_join.jaccard_classes(empty)[0].count() == 0


def test_signatures_meet():
    """Any two sets that are similar enough share a signature, whatever the classes of their tokens."""
    rng = np.random.default_rng(5)
    for n in (6, 20, 90, 130, 600, 2100):
        for share in (0.0, 0.5, 1.0):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            spare = len(a) * 15 // 115 if len(a) > 6 else 1
            b = np.unique(np.concatenate([a[: len(a) - spare // 2], rng.integers(0, 2**63, spare - spare // 2, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 85 * (len(a) + len(b) - both):
                continue
            level = lambda x, s=share: np.where(x % np.uint64(100) < np.uint64(int(100 * s)), 9, 1)
            assert set(ngram_join.signatures(a, level(a), 5, 85)) & set(ngram_join.signatures(b, level(b), 5, 85))


def test_substrings(docs, empty):
    rows = substring_dedup.dedup_substrings(docs).collect()
    assert len(rows) == len(TEXTS) and rows[0].source == "kept"
    seen, first = {}, {}
    for i, t in sorted(TEXTS, key=lambda x: 2**63 if x[0] is None else x[0]):
        w = spaced(t)
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (i, k))
    for i, t in TEXTS:
        w = spaced(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] != (i, k):
                gone[k : k + 20] = [True] * 20
        seen[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in rows} == seen
    assert substring_dedup.dedup_substrings(empty).count() == 0


@pytest.mark.parametrize("period", [m for m in substring_dedup.COVERS if m > 1])
def test_covers(period):
    cover = substring_dedup.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, " ".join(PASSAGE.split()[5:30]).upper()), (2, "a b"), (3, None), (4, "!!"), (None, "no id p0")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert (got[9].n_hit, got[9].items, got[9].contaminated) == (25, ["1"], True)
    assert (got[10].n_hit, got[7].n_hit, got[7].items) == (25, 2, ["2"])
    assert (got[None].items, got[None].n_hit) == (["", "1"], 28) and got[6].n_words == 0 and not got[6].contaminated and not got[1].contaminated
    assert got[9].source == "kept" and decontaminate.decontaminate(empty, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, items.limit(0)).collect())


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, " ".join(PASSAGE.split()[5:30])), (2, "a b"), (1, " ".join(PASSAGE.split()[40:55]))], "item_id long, text string")
    one = {r.doc_id: (r.n_hit, r.items) for r in decontaminate.decontaminate(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 1)
    assert {r.doc_id: (r.n_hit, r.items) for r in decontaminate.decontaminate(docs, items).collect()} == one


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    files = packing.public_files()
    tok = Tokenizer.from_file(files[0])
    tok.encode_special_tokens = True
    rows = packing.pack_documents(docs.dropDuplicates(["doc_id"]), *files, with_ids=True).toPandas()
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 2048 and list(g["offset"]) == [0, *g["length"].cumsum()[:-1]]
    for i, t in {i: t for i, t in TEXTS}.items():
        g = rows[rows.doc_id.isna() if i is None else rows.doc_id == i].sort_values("start")
        ids = np.concatenate(g["ids"].to_list()).astype("<u4")
        assert ids.tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids) for r in g.itertuples())
    assert packing.pack_documents(empty, *files).count() == 0


def test_differencing():
    sizes = np.random.default_rng(1).integers(1, 2048, 300)
    windows = packing.spread(sizes, 40)
    load = np.bincount(windows, sizes, 40)
    assert load.max() - load.min() < 0.1 * load.mean()
    assert all(sum(n for _, _, n in w) <= 2048 for w in packing.pack(sizes, 2048, cut=False))
    full = packing.pack(sizes, 2048)
    assert len(full) == -(-sizes.sum() // 2048) and sum(n for w in full for _, _, n in w) == sizes.sum()


def test_simhash(docs, empty):
    rows = simhash.with_next(docs, per_bucket=3).where("not guest").orderBy("bucket", "place").collect()
    order = sorted(((i, t or "") for i, t in TEXTS), key=lambda x: (x[0] is None, -(x[0] or 0)))
    want = {}
    for k, (i, t) in enumerate(order):
        want.setdefault((i, t), set()).add(order[(k + 1) % len(order)][1])
    assert len(rows) == len(TEXTS) and all(r.next in want[r.id, r.text] for r in rows)
    prints = {r.doc_id: (r.fp0, r.fp1) for r in simhash.fingerprints(docs.dropDuplicates(["doc_id"]), ["doc_id"], F.col("text")).collect()}
    far = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(prints[a], prints[b], strict=True))
    assert prints[1] == prints[2] and prints[5] == prints[6] == (0, 0) and prints[7] == prints[8]
    assert simhash.fingerprints(empty, ["doc_id"], F.col("text")).count() == 0
    assert far(1, 3) < 25 < 40 < far(1, 12)


def test_hamming_links(spark):
    rng = np.random.default_rng(3)
    marks = [tuple(int(x) for x in rng.integers(-(2**62), 2**62, 2)) for _ in range(60)]
    marks += [(a ^ (1 << int(rng.integers(0, 60))), b ^ (3 << int(rng.integers(0, 60)))) for a, b in marks[:30]]
    far = lambda x, y: sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(x, y, strict=True))
    want = {frozenset(p) for p in combinations(set(marks), 2) if far(*p) <= 4}
    got = simhash.hamming_links(spark.createDataFrame(marks, "fp0 long, fp1 long"), radius=4).collect()
    assert {frozenset([(r.a0, r.a1), (r.b0, r.b1)]) for r in got} == want


def test_languages(spark, empty):
    rows = [(i, f"the house and the {w} of this town", "en") for i, w in enumerate(["dog", "cat", "tree", "sea"] * 3)] + [(100 + i, f"das haus und die {w} der stadt über", "de") for i, w in enumerate(["katze", "kuh", "nacht"] * 4)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "the cat of the town", 0.0), (2, "und die nacht der stadt", 0.0), (3, None, 0.0), (4, "12 !", 0.0), (5, "the house and the dog of this town und die nacht der stadt über das haus", 0.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in language_id.identify(asked, model, spans=True).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"] and got[3].score == 0
    assert [s.lang for s in got[5].lang_spans] == ["en", "de"] and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(asked, language_id.train(empty)).where("lang_pred <> 'und'").count() == 0


def test_viterbi():
    rng = np.random.default_rng(2)
    first = np.array([0, 3, 3, 9, 10])
    scores, prior = rng.normal(size=(10, 3)).astype(np.float32), np.zeros(3, np.float32)
    got = language_id._paths(scores, first, prior, 0.7)
    for a, b in zip(first[:-1], first[1:], strict=True):
        value = lambda p, a=a: sum(scores[a + k, s] for k, s in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:], strict=False))
        best = max(np.ndindex(*[3] * (b - a)), key=value) if b > a else ()
        assert b == a or abs(value(best) - value(tuple(got[a:b]))) < 1e-5


def test_hmm(docs, empty):
    plain = docs.select("doc_id", "text").dropDuplicates(["doc_id"])
    counts = hmm.count_words(plain)
    texts = {i: [*spaced(lower(t)), None] for i, t in dict(TEXTS).items()}
    every = [w for t in texts.values() for w in t]
    assert (counts.tokens, counts.types, counts.texts) == (len(every), len(set(every)), len(texts))
    rows = {r.doc_id: r for r in hmm.score(plain, hmm.train(plain, counts, states=2, rounds=2), counts).collect()}
    for i, t in texts.items():
        base = sum(np.log10((every.count(w) + 1) / (len(every) + len(set(every)) + 1)) for w in t) if len(t) < 1000 else rows[i].base_score
        assert rows[i].n_tokens == rows[i].n_known == len(t) and abs(rows[i].base_score - base) < 1e-6 and rows[i].score < 0
    assert hmm.score(empty, hmm.train(empty, hmm.count_words(empty)), hmm.count_words(empty)).count() == 0


def test_hmm_forward():
    """The scaled recursion gives the sum over all paths."""
    rng = np.random.default_rng(4)
    part = lambda *s: (x := rng.random(s)) / x.sum(axis=-1, keepdims=True)
    m = hmm.Model(np.empty(0, np.uint64), np.empty(0), np.zeros(1), np.zeros(1), 0.5, part(2), part(2), part(2, 2), part(2, 5).T)
    sym, at = rng.integers(0, 5, 9), np.array([0, 4, 9])
    for (a, b), got in zip(zip(at[:-1], at[1:], strict=True), hmm._forward(m, sym, at), strict=True):
        total = sum(m.start[p[0]] * np.prod([m.emit[sym[a + k], s] for k, s in enumerate(p)]) * np.prod([m.move[x, y] for x, y in zip(p, p[1:], strict=False)]) for p in np.ndindex(*[2] * (b - a)))
        assert abs(np.log10(total) - got) < 1e-9


def test_kneser_ney(spark, docs, empty):
    texts = spark.createDataFrame([(i, f"the cat sat on the {w} mat today") for i, w in enumerate(["red", "old", "blue", "wet", "red", "old"])], "doc_id long, text string")
    model = kneser_ney.train(texts)
    n, logs = model.log10(["the cat sat on the red mat today", "zzz yyy ### qqq", ""])
    assert n.tolist() == [9, 5, 1] and logs[0] / n[0] > logs[1] / n[1]
    one = model.tables["w"].values
    assert abs(one.sum() + model.unknown - 1) < 1e-5  # the known words and the unknown
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    out = kneser_ney.classify(docs.withColumn("lang", F.lit(None).cast("string")), labels)
    assert out.count() == len(TEXTS) and kneser_ney.classify(empty, labels.limit(0)).count() == 0


PAGE = "<html><head><title>t</title></head><body><header>top</header><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one<b>two</b><p>three\n four<br>five<div class=\"comments\">no</div></article><aside>side</aside><form><input>f</form><footer>&copy; x</footer>"


def test_main_text(spark):
    assert html_text.walk(PAGE)[1] == "A & B onetwo three four five"
    assert html_text.walk("<p>a < b &lt; c<script>var t='</p>'</script> d</p><p")[1] == "a < b < c d"
    assert html_text.walk("")[1] == "" and html_text.walk("<b>x</b>y &amp")[1] == "xy &"
    rows = [(i, f"http://h/{i}", f"<body><div>box of the site</div><p>page {i}</p></body>") for i in range(8)] + [(8, "http://other/", "<div>box of the site</div>"), (9, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (1 << 20, 0):
        got = {r.page_id: r.text for r in html_text.main_text(pages, broadcast_limit=limit).collect()}
        assert got == {i: f"page {i}" for i in range(8)} | {8: "box of the site", 9: ""}
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", "x" * 200), (2, "u", "x" * 200), (3, None, None), (4, "u", "y" * 50), (5, "v\nw", "y" * 50), (0, "z", "é" * 700_000), (None, "q", "x" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    chunks = warc.read(warc.write(warc.decide(pages), f"file://{tmp_path}/w"), chunk_bytes=1 << 18).collect()
    for key, _, html in rows:
        own = sorted((c for c in chunks if c.page_id == key), key=lambda c: c.chunk)
        payload = (html or "").encode()
        last = own[-1]
        assert last.last and last.bytes_so_far == len(payload) and last.digest_so_far == hashlib.sha256(payload).hexdigest()
        assert (last.record_type, last.refers_to) == (("revisit", 1) if key in (2, None) else ("response", None))
        assert last.record_type == "revisit" or b"".join(c.data for c in own) == payload
    assert warc.read(warc.write(warc.decide(pages.limit(0)), f"file://{tmp_path}/e")).count() == 0
