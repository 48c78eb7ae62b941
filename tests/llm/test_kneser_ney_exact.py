"""Probabilities and perplexities against a plain modified Kneser-Ney, for awkward tables, too."""

import math
import pickle
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from matlink.llm import kneser_ney

WORDS = "the cat sat on red old mat and dog ran".split()
TEXTS = [" ".join(WORDS[(i * k + k * k) % (3 + i % 8)] for k in range(12)) for i in range(24)] + ["the cat", "", "the the the the"]


def discounts(values):
    n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
    if not all(n[:3]):
        return [0.0, 0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [0.0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k) for k in (1, 2, 3)]


def plain(training):
    three = Counter()
    for text in training:
        t = ["<s>", "<s>", *text.lower().split(), "</s>"]
        three.update(zip(t, t[1:], t[2:], strict=False))
    two, one = Counter(), Counter()
    for _, v, w in three:
        two[v, w] += 1
    for _, w in two:
        one[w] += 1
    levels = []
    for table, context in ((three, lambda g: g[:2]), (two, lambda g: g[:1]), ({(w,): c for w, c in one.items()}, lambda g: ())):
        d = discounts(list(table.values()))
        total, off = defaultdict(int), defaultdict(float)
        for g, c in table.items():
            total[context(g)] += c
            off[context(g)] += d[min(c, 3)]
        levels.append((table, d, total, off, context))

    def p(gram, level=0):
        if level == 3:
            return 1 / (len(one) + 1)
        table, d, total, off, context = levels[level]
        low = p(gram[1:], level + 1)
        h = context(gram)
        if not total[h]:
            return low
        c = table.get(gram, 0)
        return (c - d[min(c, 3)]) / total[h] + off[h] / total[h] * low

    def log10(text):
        t = ["<s>", "<s>", *(text or "").lower().split(), "</s>"]
        unknown = sum(len(w.encode()) for w in t[2:] if w not in one)
        return sum(math.log10(p(g)) for g in zip(t, t[1:], t[2:], strict=False)) - unknown * math.log10(32)

    return log10


def test_probabilities(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    model, log10 = kneser_ney.train(docs), plain(TEXTS)
    asked = [*TEXTS[:5], "The CAT sat", "zebra the cat", "the zebra sat on", "é ü the", "", "mat " * 300]
    n, logs = model.log10(asked)
    assert n.tolist() == [len(t.split()) + 1 for t in asked]
    assert logs == pytest.approx([log10(t) for t in asked], rel=1e-9)


def test_rows_of_all_kinds(spark):
    """Null ids, languages and texts, repeated rows, several salts of each shard, more columns."""
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        rows = [(1, "en", TEXTS[0])] * 3 + [(None, "en", TEXTS[1]), (None, None, TEXTS[1]), (2, None, None), (3, "de", ""), (4, "de", "the cat " * 4000)]
        docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("perplexity", F.lit("x"))
        model, log10 = kneser_ney.train(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")), plain(TEXTS)
        got = kneser_ney.perplexity(docs, model, ["doc_id", "lang"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    want = sorted(((i, lang, len((t or "").split()) + 1, log10(t)) for i, lang, t in rows), key=key)
    got = sorted(((r.doc_id, r.lang, r.n_tokens, r.log10) for r in got), key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-9)


def test_sample_is_bounded(spark):
    rows = [(7, TEXTS[3])] * 50 + [(i, t) for i, t in enumerate(TEXTS)] + [(8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = kneser_ney.train(docs, most_rows=5)
    assert few.shards.count() and len(few.lexicon.p.keys) < len(kneser_ney.train(docs).lexicon.p.keys) + 1
    none = kneser_ney.train(docs, most_chars=0)
    assert none.unknown == 1 and none.log10(["a b"])[1] == pytest.approx([-2 * math.log10(32)])


def test_all_rows_are_learned(spark, monkeypatch):
    """No number of trusted rows is cut, and the probabilities are the same in any number of shards."""
    texts = [f"w{i} the cat w{i % 7}" for i in range(5200)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    log10 = plain(texts)
    asked = [texts[0], texts[-1], "w3 the cat", "the w5199 w5198"]
    for size in (2 << 20, 2000):
        monkeypatch.setattr(kneser_ney, "_SHARD_BYTES", size)
        model = kneser_ney.train(docs)
        assert model.lexicon.shards == (16 if size > 2000 else 64)
        assert model.log10(asked)[1] == pytest.approx([log10(t) for t in asked], rel=1e-9)


def test_words_are_not_broadcast(spark, monkeypatch):
    """What passes through the driver doesn't grow with the words, and no number of the words is cut."""
    monkeypatch.setattr(kneser_ney, "_OFTEN", 16)
    sizes, words = [], []
    for n in (50, 5000):
        model = kneser_ney.train(spark.createDataFrame([(i, f"w{i} x{i} w{i + 1}") for i in range(n)], "doc_id long, text string"))
        sizes.append(len(pickle.dumps(model.lexicon)))
        words.append(len(model.lexicon.p.keys))
    assert words == [2 * 50 + 3, 2 * 5000 + 3] and sizes[1] < sizes[0] + 5000


@pytest.mark.parametrize("often, bits", [(0, 26), (64, 12), (1 << 18, 12)])
def test_in_place_or_by_shard(spark, monkeypatch, often, bits):
    """What is often met and bits that several n-grams share change no result; equal rows have equal ones."""
    monkeypatch.setattr(kneser_ney, "_OFTEN", often)
    monkeypatch.setattr(kneser_ney, "_BITS", bits)
    texts = [*TEXTS, *(f"the cat {w} w{i} on the {w}" for i, w in enumerate(WORDS * 20))]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:5] * 3, "doc_id long, text string")  # repeated rows count once
    model, log10 = kneser_ney.train(docs), plain(texts)
    asked = [*texts[::9], "zebra the cat", "the zebra w3", "w7 w8 cat mat on", ""]
    got = kneser_ney.perplexity(spark.createDataFrame([(i, t) for i, t in enumerate(asked)] * 3, "doc_id long, text string"), model, ["doc_id"]).collect()
    logs = {r.doc_id: r.log10 for r in got}
    assert len(got) == 3 * len(asked) and len({(r.doc_id, r.log10) for r in got}) == len(asked)
    assert [logs[i] for i in range(len(asked))] == pytest.approx([log10(t) for t in asked], rel=1e-8)
