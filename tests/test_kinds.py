"""Work done once for equal texts and equal specifications gives what it gives row by row."""

import pandas as pd
from pyspark.sql import functions as F

from matlink.functions.text import normaliser
from matlink.operators import candidates, cluster, extract, kinds
from matlink.operators.candidates import block_pairs, block_value, merged, part_number_pairs
from matlink.operators.decide import decide, sides
from matlink.operators.graph import components

TEXTS = ["GATE VALVE 4IN CL150 A216 WCB FLGD RF", "valve gate 100NB 150# WCB flanged raised face", "GATE VALVE 4IN CL300 A216 WCB FLGD RF", "PIPE 6IN STD A106 GR B", "HEX BOLT M16X50 GR 8.8 ZN", "SOMETHING ELSE", None]


def plain(rows, *columns):
    return sorted(((r.id, *(str(sorted(r[c].items()) if isinstance(r[c], dict) else r[c]) for c in columns)) for r in rows.collect()), key=str)


def test_texts_are_worked_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)], i % 3) for i in range(210)], "id long, text string, org int")
    each = rows.select("id", normaliser()(F.coalesce("text", F.lit(""))).alias("n")).select("id", F.col("n.text").alias("norm_text"), F.col("n.repairs").alias("repairs"))
    columns = ["norm_text", "repairs", "category", "attrs", "notes", "residual"]
    seen = spark.sparkContext.accumulator(0)
    real = normaliser()

    def counting():
        @F.pandas_udf("text string, repairs array<string>")
        def normal(texts: pd.Series) -> pd.DataFrame:
            seen.add(len(texts))
            return real.func(texts)

        return normal

    monkeypatch.setattr(extract, "normaliser", counting)
    got = extract.text_specs(rows)
    assert plain(got, *columns) == plain(extract.specs(each, repairs_col="repairs"), *columns)
    assert {(r.id, r.org) for r in got.select("id", "org").collect()} == {(i, i % 3) for i in range(210)}
    assert seen.value == len(TEXTS)


def test_pairs_by_kind(spark):
    """Blocks, part numbers in and across blocks, groups beyond the channel's cap: as if every pair were decided."""
    texts = [t for t in TEXTS if t] + ["GATE VALVE 4IN CL150 A216 WCB FLGD"]
    rows = [(i, texts[i % len(texts)], str(i % 3), "M" if i % 5 < 2 else None, {0: "P1", 1: f"P{i % 11}"}.get(i % 5), None) for i in range(60)]
    own = spark.createDataFrame(rows, "id long, text string, org string, maker string, mpn string, critical boolean")
    specs = extract.text_specs(own).withColumn("block", block_value(F.col("category"), F.col("attrs"))).cache()
    pairs = merged(B=block_pairs(specs, "CROSS"), M=part_number_pairs(specs, "CROSS"))
    want = decide(sides(pairs, specs)).select("id_a", "id_b", "verdict", "route", F.to_json("evidence").alias("e")).cache()
    k = kinds.kinds(specs)
    numbers = kinds.number_only(k).cache()
    of = kinds.decided(k, numbers=numbers).cache()
    got = kinds.listed(k, of.select("x", "y", "verdict", "route", F.to_json("evidence").alias("e")), numbers, most=2).withColumn("verdict", kinds.verdict(F.col("same"))).drop("same")
    assert numbers.count() and sorted(got.select(*want.columns).collect()) == sorted(want.collect())
    many = kinds.counted(k, of, numbers).join(of, ["x", "y"]).groupBy(kinds.verdict(F.col("same")).alias("verdict"), "route").agg(F.sum("pairs").alias("n"))
    assert {tuple(r) for r in many.collect()} == {tuple(r) for r in want.groupBy("verdict", "route").count().collect()}
    positive = F.col("verdict").isin(*kinds.POSITIVE)
    by_kind = components(kinds.links(k, of.where(positive), numbers))
    by_pair = components(want.where(positive).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    assert sorted(by_kind.collect()) == sorted(by_pair.collect())
    scored = lambda rows: rows.withColumn("s", F.when(F.col("verdict") == "NOT_EQUIVALENT", 0.5).otherwise(0.1))
    top = kinds.best(k, scored(of).select("x", "y", "s"), "s", 7, numbers).select("id_a", "id_b", "s").collect()
    assert top == scored(want).select("id_a", "id_b", "s").orderBy(F.desc("s"), "id_a", "id_b").limit(7).collect()


def test_lexical_neighbours_of_equal_texts(spark, monkeypatch):
    """Many records of few texts rank as each would by itself, and only texts are scored."""
    words = [["A", "B"], ["B", "A"], ["B", "C"], ["D"], ["D", "E", "E"], ["F"]]
    rows = [(i, "XY"[i % 7 == 0], str(i // 6 % 3), words[i % 6]) for i in range(90)]
    records = spark.createDataFrame(rows, "id long, category string, org string, tokens array<string>").cache()
    sizes, real = [], candidates.bm25_scores
    scored = {(r.query, r.id): round(r.score, 9) for r in real(records, records).collect()}
    monkeypatch.setattr(candidates, "bm25_scores", lambda corpus, queries: sizes.append(corpus.count()) or real(corpus, queries))
    for mode, fits in {"CROSS": lambda a, b: a[2] != b[2], "WITHIN": lambda a, b: a[2] == b[2], "BOTH": lambda a, b: True}.items():
        want = set()
        for a in rows:
            others = sorted((-scored.get((a[0], b[0]), 0.0), b[0]) for b in rows if a[1] == b[1] and a[0] != b[0] and fits(a, b))
            want |= {(a[0], other, rank + 1) for rank, (_, other) in enumerate(others[:4])}
        got = candidates.lexical_neighbours(records, records, 4, mode)
        assert {(r.id_a, r.id_b, r.rank) for r in got.collect()} == want
    assert max(sizes) < 12


def test_clear_components_are_groups_whole(spark):
    """A component without a conflict needs no edges; one with a conflict, or of too many records, is left to be followed."""
    parts = spark.createDataFrame([(i, i // 10 * 10) for i in range(30)], "node long, component long")
    classes = spark.createDataFrame([(i, 10 if i in (10, 11) else 12 if 10 <= i < 20 else i // 10 * 10) for i in range(30)], "id long, class long")
    conflicts = spark.createDataFrame([(12, 10), (0, 20)], "i long, j long")
    members, rest = cluster.clear_components(parts, classes, conflicts, None)
    assert {tuple(r) for r in members.collect()} == {(i, i // 10 * 10) for i in range(30) if not 10 <= i < 20}
    assert {r.id for r in rest.collect()} == set(range(10, 20))
    members, rest = cluster.clear_components(parts, classes, conflicts, 9)
    assert members.count() == 0 and rest.count() == 30
