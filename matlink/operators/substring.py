"""Substring search (ILIKE) of many terms in many texts by an inverted index of character n-grams.

A term is a pattern as in SQL: % is any text, _ any character, a backslash makes the next character
literal. A text that matches holds every literal piece of the pattern, so it holds the n-grams of
these pieces. Each term looks up the rarest of its n-grams in the index, and what it
finds there is held against the whole pattern. Pieces of LONGEST characters and more give n-grams of that length, shorter
ones what they have; a pattern without literal characters looks up the empty gram, which all texts have. Terms of
the same pattern are searched once, and of the index only n-grams that a pattern has are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matlink.operators.graph import cut

#: Texts of a gram that one group of a join holds; more common grams are split by a hash of the entry.
_GROUP = 50_000
#: Characters of the longest n-grams. Numbers hold the same trigrams over and over, but few the same six digits.
LONGEST = 6
#: So many n-grams of patterns are broadcast to the texts (some 100 bytes each); more of them are joined by a shuffle.
_FEW = 500_000


def folded(text: Column) -> Column:
    """The case that ILIKE compares in."""
    return F.lower(text)


def grams_of(text: Column) -> Column:
    """Distinct n-grams of one to LONGEST characters of a text, and the empty one."""

    def of(n: int) -> Column:
        starts = F.when(F.char_length(text) >= n, F.sequence(F.lit(1), F.char_length(text) - (n - 1)))
        return F.transform(F.coalesce(starts, F.expr("cast(array() AS array<int>)")), lambda i: F.substring(text, i, F.lit(n)))

    return F.array_distinct(F.concat(F.array(F.lit("")), *(of(n) for n in range(1, LONGEST + 1))))


def pattern_of(term: Column) -> Column:
    """What ILIKE '%term%' looks for, where a backslash stands before %, _ and itself only."""
    return F.regexp_replace(F.concat(F.lit("%"), folded(term), F.lit("%")), r"(?s)(\\[%_\\])|\\(.)", "$1$2")


def pieces(pattern: Column) -> Column:
    """Literal pieces of a pattern: what stands between % and _, escapes resolved."""
    return F.transform(F.regexp_extract_all(pattern, F.lit(r"(?s)((?:[^\\%_]|\\.)+)"), F.lit(0)), lambda p: F.regexp_replace(p, r"(?s)\\(.)", "$1"))


def index(entries: DataFrame) -> DataFrame:
    """(gram, entry) of entries (entry, text): which entries have a text with the gram. Null texts have none."""
    return entries.where("text is not null").select("entry", F.explode(grams_of(folded(F.col("text")))).alias("gram")).distinct()


def search(terms: DataFrame, entries: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """(query, entry) of all entries of which a text holds the term, each once.

    terms: query, term; the term is trimmed and may match anywhere in the text (as ILIKE '%term%'). A null
    term finds nothing, an empty one every entry with a text. entries: entry, text; an entry
    may have several texts. postings: index(entries), where it is kept.
    """
    asked = patterns(terms)
    return matches(asked.select("pattern").distinct(), entries, postings).join(asked, "pattern").select("query", "entry")


def patterns(terms: DataFrame) -> DataFrame:
    """(query, pattern) of terms (query, term), each once; a null term has none."""
    return terms.where("term is not null").select("query", pattern_of(F.trim("term")).alias("pattern")).distinct()


def matches(asked: DataFrame, entries: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """(pattern, entry) of all entries of which a text is like a pattern of asked (pattern, each once), each once; see search()."""
    long = lambda p: F.transform(F.sequence(F.lit(1), F.char_length(p) - (LONGEST - 1)), lambda i: F.substring(p, i, F.lit(LONGEST)))
    grams = F.transform(pieces(F.col("pattern")), lambda p: F.when(F.char_length(p) >= LONGEST, long(p)).otherwise(F.array(p)))
    needed = cut(asked.select("pattern", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(grams)))).alias("gram")))
    few = needed.select("gram").distinct().count() <= _FEW
    texts = entries.where("text is not null").select("entry", folded(F.col("text")).alias("text"))

    def held(grams: DataFrame) -> DataFrame:
        """(gram, entry, any others of grams) where a text has one of grams; an entry counts once a text without postings."""
        grams = F.broadcast(grams) if few else grams
        if postings is not None:
            return postings.join(grams, "gram")
        return texts.select("entry", F.explode(grams_of(F.col("text"))).alias("gram")).join(grams, "gram")

    sizes = held(needed.select("gram").distinct()).groupBy("gram").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("pattern").orderBy(F.coalesce("n", F.lit(0)), F.desc(F.char_length("gram")), "gram"))
    # a gram that no text has is the rarest, and the join on it finds nothing
    rarest = needed.join(sizes, "gram", "left").withColumn("rank", rank).where("rank = 1")
    rarest = cut(rarest.select("pattern", "gram", F.ceil(F.coalesce("n", F.lit(1)) / _GROUP).cast("int").alias("groups")))
    spread = rarest.select("pattern", "gram", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    found = held(rarest.select("gram", "groups").distinct()).select("gram", "entry", F.pmod(F.xxhash64("entry"), F.col("groups")).cast("int").alias("group")).distinct()
    found = found.join(spread, ["gram", "group"]).select("pattern", "entry")
    return found.join(texts, "entry").where(F.expr("text LIKE pattern")).select("pattern", "entry").distinct()
