"""Terms that ask the same are searched once, and long pieces look up long n-grams."""

from pyspark.sql import functions as F

from matlink.operators import substring
from matlink.plans import serving


def test_equal_terms_are_searched_once(spark, monkeypatch):
    entries = spark.createDataFrame([(i, f"C{i:03}", f"pump {i}", "red valve", "AB"[i % 2]) for i in range(60)], "entry long, code string, short_desc string, long_desc string, category string")
    crosswalk = entries.select("entry", F.concat(F.lit("O"), (F.col("entry") % 3).cast("string")).alias("org"), F.lit(None).cast("string").alias("legacy_code"), F.lit("ACTIVE").alias("status"))
    rows = [(q, (" VALVE ", "valve", "pump 7", None)[q % 4], (None, "A", "B")[q % 3], "O1" if q % 5 == 0 else None) for q in range(40)]
    asked = spark.createDataFrame(rows, "query long, term string, category string, org string")
    seen, real = [], substring.matches
    monkeypatch.setattr(substring, "matches", lambda patterns, *more: seen.append(patterns.count()) or real(patterns, *more))
    got = {}
    for r in serving.registry_pages(asked, entries, crosswalk, 4).collect():
        got.setdefault(r.query, []).append((r["rank"], r.code, r.total))
    assert seen == [2]
    for q, term, category, org in rows:
        hits = [i for i in range(60) if term and (term != "pump 7" or i == 7) and category in (None, "AB"[i % 2]) and org in (None, f"O{i % 3}")]
        assert sorted(got.get(q, [])) == [(n + 1, f"C{i:03}", len(hits)) for n, i in enumerate(sorted(hits, reverse=True)[:4])]


def test_long_pieces(spark):
    """A number of six digits isn't looked up by a trigram that a thousand others have."""
    row = spark.createDataFrame([("abcdefgh",)], "t string").select(substring.grams_of(F.col("t")).alias("g")).first()
    assert {"abcdef", "bcdefg", "cdefgh", "abcde", "h", ""} <= set(row.g) and "abcdefg" not in row.g
    entries = spark.createDataFrame([(i, f"N{i * 7919 % 1000003:07}") for i in range(500)], "entry long, text string")
    terms = spark.createDataFrame([(i, f"{i * 7919 % 1000003:07}") for i in range(0, 500, 7)], "query long, term string")
    assert sorted(tuple(r) for r in substring.search(terms, entries).collect()) == [(i, i) for i in range(0, 500, 7)]
