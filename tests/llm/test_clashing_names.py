"""Extra columns with the names of helpers and of results: kept or replaced, and never in the way."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matlink.llm import decontaminate, language_id, ngram_join, packing, simhash, substring_dedup, suffix_dedup

PASSAGE = " ".join(f"p{i}" for i in range(40))
ROWS = [(1, f"{PASSAGE} alone"), (2, f"start {PASSAGE}"), (3, "das ist ein Haus und der Hund"), (None, f"x {PASSAGE} y"), (None, f"x {PASSAGE} z"), (None, None), (4, "")]
NAMES = ["__bit", "__word", "__bits", "__hit", "__HIT", "__b0", "__block0", "__found", "__n", "__t", "__w", "__i", "__h0", "__own0", "__own3", "__likely0", "__id", "__places", "__done", "id", "texts", "bucket", "hit", "gone", "key", "n", "fp", "row", "__k0", "word"]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.createDataFrame([(i, t, "en" if i != 3 else "de", "s", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    spark.conf.set("spark.sql.caseSensitive", "true")
    yield table.select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES))
    spark.conf.unset("spark.sql.caseSensitive")


def kept(df):
    rows = df.collect()
    assert all(r[n] == f"own {n}" for r in rows for n in NAMES)
    return {(r.doc_id, r.text): r for r in rows}


def test_operators(spark, docs):
    assert {k: r.lang_pred for k, r in kept(language_id.identify(docs, language_id.train(docs), spans=True)).items()}[3, ROWS[2][1]] == "de"
    items = spark.createDataFrame([("a", PASSAGE)], "item_id string, text string")
    assert kept(decontaminate.decontaminate(docs, items))[ROWS[0]].contaminated
    done = kept(substring_dedup.dedup_substrings(docs))
    assert [done[r].n_removed for r in ROWS] == [0, 40, 0, 41, 41, 0, 0] or [done[r].n_removed for r in ROWS[:3]] == [0, 40, 0]
    done = kept(suffix_dedup.dedup_suffixes(docs, window=60))
    assert done[ROWS[0]].n_removed > 60 and done[ROWS[2]].n_removed == 0


def test_stages(spark, docs, data):
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, data)
        assert out.columns == docs.columns, name
        kept(out)
    assert packing.pack_documents(docs, *packing.public_files()).count() > 0
    assert ngram_join.jaccard_classes(docs)[0].count() == len(ROWS)


def test_keys_of_fingerprints(spark, docs):
    rows = simhash.fingerprints(docs.where("doc_id is not null"), ["doc_id", "__n", "__t", "__h0", "__k0"], F.col("text")).collect()
    assert len(rows) == 4 and all(r["__n"] == "own __n" and r["__k0"] == "own __k0" for r in rows)


def test_rows_without_ids_are_texts_of_their_own(spark):
    """Two different texts without ids that hold a passage at the same place keep it once."""
    table = spark.createDataFrame([(None, f"{PASSAGE} one"), (None, f"{PASSAGE} two"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring_dedup.dedup_substrings(table).collect()) == [0, 0, 40]
