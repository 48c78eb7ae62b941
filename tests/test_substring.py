"""Substring search against a plain matcher of patterns."""

import re

import pytest

from matlink.operators import substring


def matches(text, term):
    """ILIKE '%term%' with backslash escapes."""
    out, pattern, i = "", f"%{term.strip(' ')}%".lower(), 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
        i += 1
    return re.fullmatch(out, text.lower(), re.S) is not None


ENTRIES = [(1, "NMC-00000000018"), (1, "VLV GATE 4IN CL150"), (2, "NMC-00000000026"), (2, "Flange, weld_neck, 50% nickel"), (3, "a\\b"), (3, None), (4, "é Ünïcode"), (5, ""), (6, "x\ny"), (7, "aaaa"), (7, "aaab"), (8, None)]
TERMS = ["gate", "GATE 4", "50\\%", "50%nick", "weld\\_neck", "weld_neck", "w__d", "cl", "4", "", " ", "%", "_", "____", "zzz", "nmc-%18", "a\\\\b", "\\", "\\a\\a", "É", "x_y", "%%%", "aab", "N%0_8", " gate ", "a%a%a%a%a", "nick%50"]


def test_terms(spark):
    entries = spark.createDataFrame(ENTRIES, "entry long, text string")
    terms = spark.createDataFrame([*enumerate(TERMS), (99, None)], "query long, term string")
    got = {(r.query, r.entry) for r in substring.search(terms, entries).collect()}
    assert got == {(q, e) for q, t in enumerate(TERMS) for e, text in ENTRIES if text is not None and matches(text, t)}
    kept = substring.index(entries)
    assert {(r.query, r.entry) for r in substring.search(terms, entries, kept).collect()} == got


def test_common_grams_are_split(spark, monkeypatch):
    monkeypatch.setattr(substring, "_GROUP", 3)
    entries = spark.createDataFrame([(i, f"item {i}") for i in range(50)], "entry long, text string")
    terms = spark.createDataFrame([(1, "item"), (2, "7"), (3, "item 4")], "query long, term string")
    got = substring.search(terms, entries).collect()
    assert len(got) == 50 + 5 + 11 == len(set(got))


@pytest.mark.parametrize("entries,terms", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "")])])
def test_nothing(spark, entries, terms):
    assert substring.search(spark.createDataFrame(terms, "query long, term string"), spark.createDataFrame(entries, "entry long, text string")).count() == 0
