"""More buckets, ranges than these small tables would get give the same rows."""

import pytest

from matlink.llm import hmm, simhash, substring_dedup
from matlink.llm.queries import QUERIES


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("module, name, value, query", [
    (substring_dedup, "_TASK_BYTES", 20_000, "op8_substring_dedup"),
])
def test_same_rows(spark, data, monkeypatch, module, name, value, query):
    want = rows(QUERIES[query](spark, data))
    monkeypatch.setattr(module, name, value)
    assert rows(QUERIES[query](spark, data)) == want


def test_word_counts(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    few = hmm.count_words(docs)
    monkeypatch.setattr(hmm, "_BUCKET_BYTES", 20_000)
    many = hmm.count_words(docs)
    assert many.buckets > few.buckets
    assert (many.tokens, many.types, many.texts) == (few.tokens, few.types, few.texts)


@pytest.mark.parametrize("per_bucket", [1, 7, 40])
def test_ranges_of_ids(spark, per_bucket):
    ids = [3 * i - 200 for i in range(150)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    got = simhash.with_next(docs, per_bucket=per_bucket).where("not guest").collect()
    order = sorted(ids, reverse=True)
    assert {r.id: r.next for r in got} == {i: f"text {order[(k + 1) % len(order)]}" for k, i in enumerate(order)}
    assert len({r.bucket for r in got}) >= min(150 // per_bucket, 2)
