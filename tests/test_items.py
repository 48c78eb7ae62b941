"""Decisions on pairs of texts, groups under a veto, and small helpers."""

import pytest
from pyspark.sql import functions as F

from matlink.functions.similarity import token_set
from matlink.functions.text import normaliser, spellings
from matlink.operators.cluster import constrained_clusters
from matlink.operators.decide import decide, sides
from matlink.operators.extract import specs
from matlink.operators.graph import components
from matlink.operators.records import checked_mapping, suggested_mapping
from matlink.sources.policy import PolicyError, dictionary, parse_policies

PAIRS = [
    ("GATE VALVE 4IN CL150 A216 WCB FLGD RF", "valve gate 100NB 150# WCB flanged raised face", "EQUIVALENT", "REVIEW"),
    ("GATE VALVE 4IN CL150 A216 WCB FLGD RF", "GATE VALVE 4IN CL300 A216 WCB FLGD RF", "NOT_EQUIVALENT", "NONE"),
    ("GATE VALVE 4IN CL150 A216 WCB FLGD", "GATE VALVE 4IN CL150 A216 WCB FLGD RF", "INSUFFICIENT_DATA", "REVIEW"),
    ("GATE VALVE 4IN CL150 A216 WCB FLGD RF NACE", "GATE VALVE 4IN CL150 A216 WCB FLGD RF", "EQUIVALENT", "REVIEW"),
    ("PIPE 6IN STD A106 GR B", "PIPE SMLS 6 INCH SCH 40 A106 GR.B", "EQUIVALENT", "REVIEW"),
    ("HEX BOLT M16X50 GR 8.8 ZN", "BOLT, HEX HEAD, M16 x 50, 8.8, zinc plated", "EQUIVALENT", "AUTO_ELIGIBLE"),
    ("HEX BOLT M16X50 GR 8.8", "HEX BOLT M16X50 GR 8.8 ZN", "EQUIVALENT", "REVIEW"),
    ("NUT M16 8.8", "NUT HEX M16 8.8", "EQUIVALENT", "REVIEW"),
    ("MOTOR AC IND 15 HP 4P", "AC INDUCTION MOTOR 11.2 KW 4 POLE", "EQUIVALENT", "REVIEW"),
    ("FLANGE WN 4IN CL150 RF SS316", "FLANGE WN 4IN CL150 RF A182 F316", "INSUFFICIENT_DATA", "REVIEW"),
    ("GASKET SPIRAL WOUND 4IN CL150 SS316/GRAF", "PIPE 4IN", "NOT_EQUIVALENT", "NONE"),
    ("SOMETHING ELSE", "PIPE 4IN", "INSUFFICIENT_DATA", "REVIEW"),
]


@pytest.mark.parametrize("swap", [False, True])
def test_golden_pairs(spark, swap):
    texts = [(2 * i + j, p[j]) for i, p in enumerate(PAIRS) for j in (0, 1)]
    norm = spark.createDataFrame(texts, "id long, text string").select("id", normaliser()("text").alias("n")).select("id", F.col("n.text").alias("norm_text"))
    none = F.lit(None).cast("string")
    rows = specs(norm).withColumns({"mpn": none, "maker": none, "critical": F.lit(None).cast("boolean")}).cache()
    pairs = spark.createDataFrame([(2 * i + swap, 2 * i + 1 - swap) for i in range(len(PAIRS))], "id_a long, id_b long")
    got = {min(r.id_a, r.id_b) // 2: (r.verdict, r.route) for r in decide(sides(pairs, rows)).collect()}
    assert got == {i: (p[2], p[3]) for i, p in enumerate(PAIRS)}


def test_spelling():
    known = spellings(dictionary())
    assert known["LFANGE"] == "FLANGE" and known["PIEP"] == "PIPE" and known["INDUCTINO"] == "INDUCTION"
    assert "STUB" not in known and "PIPES" in known and "BOLT" not in known


def test_clusters_hold_no_conflict(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.7), (8, 9, 0.5)], "i long, j long, score double")
    conflicts = spark.createDataFrame([(1, 3)], "i long, j long")
    members, blocked = constrained_clusters(edges, conflicts)
    assert {(r.id, r.cluster) for r in members.collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (8, 8), (9, 8)}
    assert [(r.i, r.j, r.reason) for r in blocked.collect()] == [(2, 3, "conflict")]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 0, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_set():
    assert token_set("A B", "B A") == 1 and token_set("A B C", "A B") == 1 and token_set("", "A") == 0
    assert token_set("GATE VALVE", "BALL VALVE") < 0.85


def test_mapping():
    assert suggested_mapping(["MARA-MATNR", "MAKT-MAKTX", "MEINS", "Plant"], dictionary().headers) == ({"MARA-MATNR": "legacy_code", "MAKT-MAKTX": "short_text", "MEINS": "uom", "Plant": "plant"}, "SAP")
    with pytest.raises(ValueError, match="legacy_code"):
        checked_mapping({"a": "uom"}, ["a"], {"uom", "legacy_code"})


def test_policy_errors():
    with pytest.raises(PolicyError, match="no attribute"):
        parse_policies("[{category: X, version: 1, critical_default: true, core: [a], rule_text: {b: t}}]")
