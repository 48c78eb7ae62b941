"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of W consecutive words (one window if it has fewer).
A text holds a window only if it holds every word of it, so one word is a sufficient
prefix: the rarest one, by counts over all texts. The texts are joined with these
words; the word's place bounds where the window can start and end (inside the text);
what is left is verified by the hash of the whole window and then word by word.

The items are taken in blocks of bounded size, each against all texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matlink.llm.common import batches, free_name, prepare
from matlink.llm.wordvec import ALNUM, Words, rolling

#: Characters of items that are broadcast at a time.
BLOCK_CHARS = 16 << 20
_TABLE = 1 << 18


def _words(texts: list) -> Words:
    return Words(texts, kind=ALNUM, lower=True)


class _Block:
    """The windows of some items, as arrays: item, size, hash, words; by prefix word after index()."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        w = _words([t for _, t in items])
        self.names = [name for name, _ in items]
        self.item, self.size, self.hash, self.start = [], [], [], []
        for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
            if b > a:
                n = min(window, b - a)
                h = rolling(w.hashes[a:b], n)
                self.item += [i] * len(h)
                self.size += [n] * len(h)
                self.start += range(a, a + len(h))
                self.hash.append(h)
        self.item, self.size, self.start = (np.array(x, np.int64) for x in (self.item, self.size, self.start))
        self.hash = np.concatenate(self.hash) if self.hash else np.empty(0, np.uint64)
        self.words = [w.word(i) for i in range(len(w.hashes))]
        self.word_hash = w.hashes
        self.vocabulary = np.unique(w.hashes)

    def index(self, counts: np.ndarray) -> None:
        """The rarest word of each window becomes its prefix; windows are sorted by that."""
        of = counts[np.searchsorted(self.vocabulary, self.word_hash)] if len(self.vocabulary) else counts
        at = np.empty(len(self.item), np.int64)
        for i, (s, n) in enumerate(zip(self.start.tolist(), self.size.tolist(), strict=True)):
            at[i] = int(np.lexsort((self.word_hash[s : s + n], of[s : s + n]))[0])
        prefix = self.word_hash[self.start + at] if len(at) else np.empty(0, np.uint64)
        order = np.argsort(prefix, kind="stable")
        self.item, self.size, self.start, self.hash, self.at = self.item[order], self.size[order], self.start[order], self.hash[order], at[order]
        self.prefix, self.lo, n = np.unique(prefix[order], return_index=True, return_counts=True)
        self.hi = self.lo + n
        self.table = _table(self.prefix)


def _table(hashes: np.ndarray) -> np.ndarray:
    """A small table that tells most other hashes apart without a search."""
    out = np.zeros(_TABLE, bool)
    out[(hashes % np.uint64(_TABLE)).astype(np.int64)] = True
    return out


def _found(hashes: np.ndarray, among: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in hashes that hold a value of the sorted array among; the index there."""
    at = np.flatnonzero(table[(hashes & np.uint64(_TABLE - 1)).astype(np.int64)])
    to = np.minimum(np.searchsorted(among, hashes[at]), max(len(among) - 1, 0))
    hit = among[to] == hashes[at] if len(among) else np.zeros(len(at), bool)
    return at[hit], to[hit]


def _blocks(items: DataFrame, window: int):
    """The items as blocks; the driver holds one at a time."""
    held, size = [], 0
    for name, text in items.toLocalIterator():
        held.append((name or "", text))
        size += len(text or "") + 1
        if size > BLOCK_CHARS:
            yield _Block(held, window)
            held, size = [], 0
    if held:
        yield _Block(held, window)


def _counts(texts: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of each word of a block in all texts."""
    known = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def count(frames):
        total, table = np.zeros(len(known.value), np.int64), _table(known.value)
        for frame in frames:
            text = frame["text"].tolist()
            for a, b in batches(text):
                total += np.bincount(_found(_words(text[a:b]).hashes, known.value, table)[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"word": at, "n": total[at]})

    got = texts.select("text").mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(vocabulary), np.int64)
    out[got["word"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def _scanner(spark: SparkSession, block: _Block):
    """A function of texts: words, spans of windows and items of a block."""
    sent = spark.sparkContext.broadcast(block)

    def verified(w: Words, b: _Block) -> tuple[np.ndarray, np.ndarray]:
        places, which = _found(w.hashes, b.prefix, b.table)
        times = b.hi[which] - b.lo[which]
        entry = np.repeat(b.lo[which] - np.cumsum(times) + times, times) + np.arange(times.sum())
        start = np.repeat(places, times) - b.at[entry]
        text = np.repeat(np.searchsorted(w.first, places, side="right") - 1, times)
        ok = (start >= w.first[text]) & (start + b.size[entry] <= w.first[text + 1])
        start, entry = start[ok], entry[ok]
        same = np.zeros(len(start), bool)
        for n in np.unique(b.size[entry]).tolist():
            mine = np.flatnonzero(b.size[entry] == n)
            for part in range(0, len(mine), 1 << 16):
                at = mine[part : part + (1 << 16)]
                grams = rolling_at(w.hashes, start[at], n)
                same[at] = grams == b.hash[entry[at]]
        start, entry = start[same], entry[same]
        exact = np.fromiter(
            (all(w.word(s + j) == b.words[o + j] for j in range(n)) for s, o, n in zip(start.tolist(), b.start[entry].tolist(), b.size[entry].tolist(), strict=True)), bool, len(start)
        )
        return start[exact], entry[exact]

    @F.pandas_udf("n_words long, spans array<struct<start:int,end:int>>, items array<string>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        b, text_list, parts = sent.value, texts.tolist(), []
        for lo, hi in batches(text_list):
            w = _words(text_list[lo:hi])
            spans, items = [[] for _ in range(hi - lo)], [set() for _ in range(hi - lo)]
            start, entry = verified(w, b)
            text = np.searchsorted(w.first, start, side="right") - 1
            for t, s, e in zip(text.tolist(), (start - w.first[text]).tolist(), entry.tolist(), strict=True):
                spans[t].append((s, s + int(b.size[e])))
                items[t].add(b.names[b.item[e]])
            parts.append(pd.DataFrame({"n_words": w.counts(), "spans": [_merged(x) for x in spans], "items": [sorted(x) for x in items]}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"n_words": [], "spans": [], "items": []})

    return scan


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Spans that don't overlap or touch, in order."""
    held: list[dict] = []
    for a, b in sorted(spans):
        if held and a <= held[-1]["end"]:
            held[-1]["end"] = max(b, held[-1]["end"])
        else:
            held.append({"start": a, "end": b})
    return held


def rolling_at(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """rolling(h, n) at those starts only."""
    if not len(starts):
        return np.empty(0, np.uint64)
    taken = h[starts[:, None] + np.arange(n)].reshape(-1)
    return rolling(taken, n)[::n]


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, least_percent: int = 5) -> DataFrame:
    """docs with n_words, n_hit, spans (merged, of hit words), items (sorted item ids) and contaminated.

    Words are ASCII letters (lower-cased) and digits and all characters beyond ASCII. A null
    text has no words and isn't contaminated; an item without words occurs nowhere. A text
    is contaminated if at least least_percent of its words lie inside windows. Item ids are
    compared as strings; a null one is the empty string; items of the same id count once.
    Each row is judged by its own text, whatever its id. Columns of docs with the name of a
    result are replaced; others are kept. The blocks of items must fit a Python worker.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.col(text_col).cast("string")
    blocks = []
    for block in _blocks(items.select(F.col(item_col).cast("string"), F.col(item_text_col).cast("string")), window):
        block.index(_counts(docs.select(text.alias("text")), block.vocabulary))
        blocks.append(_scanner(spark, block))
    blocks = blocks or [_scanner(spark, _empty(window))]

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def merged(lists: pd.Series) -> pd.Series:
        return pd.Series([_merged([(s["start"], s["end"]) for s in spans]) for spans in lists])

    results = ["n_words", "n_hit", "spans", "items", "contaminated"]
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in results]
    own = free_name(docs.columns, "__block")
    found = docs.select(*rest, *(scan(text).alias(f"{own}{i}") for i, scan in enumerate(blocks)))
    of = lambda c: [F.col(f"{own}{i}.{c}") for i in range(len(blocks))]
    found = found.select(*rest, F.col(f"{own}0.n_words").alias("n_words"), (merged(F.concat(*of("spans"))) if len(blocks) > 1 else F.col(f"{own}0.spans")).alias("spans"), F.array_sort(F.array_distinct(F.concat(*of("items")))).alias("items"))
    found = found.withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"))
    contaminated = (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * least_percent)
    return found.withColumn("contaminated", contaminated).select(*rest, *results)


def _empty(window: int) -> _Block:
    block = _Block([("", None)], window)
    block.index(np.zeros(0, np.int64))
    return block


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, in 13-word windows."""
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")
