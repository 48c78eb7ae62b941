"""Substring dedup by difference-cover anchors.

A window of W consecutive words is a repeat if the same words also start earlier
(smaller id, or earlier in the same text). All words that repeats cover are removed.

A difference cover of period m holds, for any two places i and j, a shift below m
that takes both to cover places modulo m. So two equal windows of W words share an
aligned anchor: an equal run of W - m + 1 words at a cover place in both. Only these
anchors (4 in 13 places for W = 20) are hashed and dealt out:

1. anchors that occur twice are reported back to their texts;
2. each is extended to the windows of W words around it; those are hashed, dealt out,
   and all but the first start of each hash are reported back;
3. the texts drop the words that reported windows cover.

Rows travel as packed arrays, one for each bucket of hashes and some texts. Before
that each task keeps one start of every hash, so that a passage of a third of all
texts sends a row a task, not a row a text. Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matlink.llm.common import batches, buckets_for, cut, free_name, prepare, with_likely
from matlink.llm.wordvec import Words, mix, rolling, valid_starts

#: Perfect difference covers by period. Fixed values.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

#: Starts that a task holds before it sends them.
_HELD = 600_000
#: Bytes of text whose starts one task compares; more text makes more tasks.
_TASK_BYTES = 128 << 20
#: Rows without an id have one from here on.
_NO_ID = 1 << 62


def _row_id(id_col: Column, text: Column) -> Column:
    """The id of a row; without one, a number of its text above all ids."""
    return F.coalesce(id_col.cast("long"), F.xxhash64(text.cast("string")).bitwiseAND(F.lit(_NO_ID - 1)).bitwiseOR(F.lit(_NO_ID)))


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of at least a third of the window."""
    m = max(m for m in COVERS if window - m + 1 >= max(1, window // 3))
    return m, COVERS[m]


class _Starts:
    """Starts (hash, id, place) on their way; give() yields rows of them and of reports."""

    def __init__(self, buckets: int, first_only: bool):
        self.buckets, self.first_only, self.held, self.size = buckets, first_only, [], 0
        self.reports = _Reports(buckets)

    def add(self, h: np.ndarray, ids: np.ndarray, places: np.ndarray):
        if len(h):
            self.held.append((h, ids, places))
            self.size += len(h)

    def give(self, least: int = 1):
        if self.size < max(least, 1):
            return
        h, ids, places = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order = np.lexsort((places, ids, h))
        h, ids, places = h[order], ids[order], places[order]
        head, first, other = _first_of_each(h, ids, places)
        # a repeat has another start than the first; an anchor is one, too, if any start repeats it
        flag = np.zeros(len(h), np.uint8)
        if not self.first_only:
            flag[first[other]] = 1
        self.reports.add(ids[other], places[other])
        h, ids, places, flag = h[head], ids[head], places[head], flag[head]
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((places, ids, bucket))
        h, ids, places, flag, bucket = h[order], ids[order], places[order], flag[order], bucket[order]
        yield _frame((b, False, h[x].astype("<u8").tobytes() + ids[x].astype("<i8").tobytes() + places[x].astype("<i4").tobytes() + flag[x].tobytes()) for b, x in _runs(bucket))
        yield from self.reports.give()

    @staticmethod
    def unpack(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = []
        for p in packed:
            n = len(p) // 21
            parts.append((np.frombuffer(p, "<u8", n), np.frombuffer(p, "<i8", n, 8 * n), np.frombuffer(p, "<i4", n, 16 * n), np.frombuffer(p, np.uint8, n, 20 * n)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class _Reports:
    """Places of texts on their way to them, packed by buckets of ids."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size = buckets, [], 0

    def add(self, ids: np.ndarray, places: np.ndarray):
        if len(ids):
            self.held.append((ids, places))
            self.size += len(ids)

    def give(self, least: int = 1):
        if self.size < max(least, 1):
            return
        ids, places = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        bucket = (mix(ids.view(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((places, ids, bucket))
        ids, places, bucket = ids[order], places[order], bucket[order]
        yield _frame((b, True, ids[x].astype("<i8").tobytes() + places[x].astype("<i4").tobytes()) for b, x in _runs(bucket))

    @staticmethod
    def unpack(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = [(np.frombuffer(p, "<i8", len(p) // 12), np.frombuffer(p, "<i4", len(p) // 12, len(p) // 12 * 8)) for p in packed]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


_ROWS = "bucket int, report boolean, packed binary"


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["bucket", "report", "packed"])


def _runs(values: np.ndarray):
    """Each value of a sorted array and where it stands."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]]) if len(values) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(values[a]), slice(int(a), int(b))


def _first_of_each(h: np.ndarray, ids: np.ndarray, places: np.ndarray):
    """Of sorted starts: is it the first of its hash, where that first is, is it another start than that."""
    head = np.concatenate([[True], h[1:] != h[:-1]])
    first = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
    return head, first, (ids != ids[first]) | (places != places[first])


def _by_bucket(frames, judge):
    """judge(list of packed) of each bucket of rows sorted by bucket."""
    held, now = [], None
    for frame in frames:
        for b, p in zip(frame["bucket"].tolist(), frame["packed"].tolist(), strict=True):
            if b != now and held:
                yield from judge(held)
                held = []
            now = b
            held.append(p)
    if held:
        yield from judge(held)


def _repeats(starts: DataFrame, buckets: int, parts: int, first_only: bool) -> DataFrame:
    """(id, places) of the starts whose hash has another start; first_only: but for the first of each."""

    def find(frames):
        reports = _Reports(buckets)

        def judge(packed: list[bytes]):
            h, ids, places, flag = _Starts.unpack(packed)
            order = np.lexsort((places, ids, h))
            h, ids, places, flag = h[order], ids[order], places[order], flag[order]
            head, _, hit = _first_of_each(h, ids, places)
            if not first_only:
                group = np.cumsum(head) - 1
                hit = (np.bincount(group, hit | (flag > 0)) > 0)[group]
            reports.add(ids[hit], places[hit])
            yield from reports.give(_HELD)

        def own():
            for frame in frames:
                passed = frame["report"].to_numpy(bool)
                if passed.any():
                    reports.add(*_Reports.unpack(frame["packed"][passed].tolist()))
                yield frame[~passed]

        yield from _by_bucket(own(), judge)
        yield from reports.give()

    def gather(frames):
        def judge(packed: list[bytes]):
            ids, places = _Reports.unpack(packed)
            order = np.lexsort((places, ids))
            ids, places = ids[order], places[order]
            yield pd.DataFrame([(i, places[x]) for i, x in _runs(ids)], columns=["id", "places"])

        yield from _by_bucket(frames, judge)

    found = starts.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInPandas(find, _ROWS)
    return found.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInPandas(gather, "id long, places array<int>")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """docs with n_words, n_removed, removed (word spans start, end) and kept_text (kept words joined by one space).

    Words are runs of other characters than ASCII white space, as they stand. A text of
    fewer words than the window keeps them all; a null text has none and gives an empty
    one. Rows of the same id are versions of one text: equal starts in both are one.
    Rows with a null id stand after those of all ids below 2**62, in an order of their texts'
    hashes; equal ones are one text. Columns of docs with the name of a result are
    replaced; others are kept.
    """
    spark = docs.sparkSession
    prepare(spark)
    period, cover = cover_for(window)
    anchor = window - period + 1
    texts = docs.select(_row_id(F.col(id_col), F.col(text_col)).alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = buckets_for(texts, "text", max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), _TASK_BYTES)
    buckets = 2 * parts

    def anchors(frames):
        out = _Starts(buckets, first_only=False)
        for frame in frames:
            ids, text = frame["id"].to_numpy(np.int64), frame["text"].tolist()
            for a, b in batches(text):
                w = Words(text[a:b])
                ok = valid_starts(w.first, anchor)
                owner = w.owner()[: len(ok)]
                place = np.arange(len(ok)) - w.first[owner]
                at = np.flatnonzero(ok & np.isin(place % period, cover))
                out.add(rolling(w.hashes, anchor)[at], ids[a:b][owner[at]], place[at].astype(np.int32))
                yield from out.give(_HELD)
        yield from out.give()

    near = cut(_repeats(texts.select("id", "text").mapInPandas(anchors, _ROWS), buckets, parts, first_only=False))

    def windows(frames):
        out = _Starts(buckets, first_only=True)
        for frame in frames:
            ids, text, places = frame["id"].to_numpy(np.int64), frame["text"].tolist(), frame["places"].tolist()
            for a, b in batches(text):
                w = Words(text[a:b])
                ok = valid_starts(w.first, window)
                step = np.zeros(len(w.hashes) + 1, np.int32)
                for i in range(a, b):
                    at = np.asarray(places[i], np.int64)
                    lo, hi = w.first[i - a], w.first[i - a + 1]
                    at = at[at < hi - lo]  # places of another version of this text
                    np.add.at(step, lo + np.maximum(at - period + 1, 0), 1)
                    np.add.at(step, lo + at + 1, -1)
                at = np.flatnonzero(ok & (np.cumsum(step)[: len(ok)] > 0))
                owner = w.owner()[at]
                out.add(rolling(w.hashes, window)[at], ids[a:b][owner], (at - w.first[owner]).astype(np.int32))
                yield from out.give(_HELD)
        yield from out.give()

    touched = with_likely(texts, "__hit", F.col("id"), near, "id").where("__hit").drop("__hit").join(near, "id").select("id", "text", "places")
    repeats = cut(_repeats(touched.mapInPandas(windows, _ROWS), buckets, parts, first_only=True))

    @F.pandas_udf("n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string")
    def finish(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        rows = []
        for text, starts in zip(texts.tolist(), places.tolist(), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            spans = []
            if starts is not None and len(words) >= window:
                for p in np.unique(np.asarray(starts)).tolist():
                    if p + window > len(words):
                        break
                    if spans and p <= spans[-1][1]:
                        spans[-1][1] = p + window
                    else:
                        spans.append([p, p + window])
            kept, at = [], 0
            for lo, hi in spans:
                kept += words[at:lo]
                at = hi
            kept += words[at:]
            rows.append((len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in spans], b" ".join(kept).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "removed", "kept_text"])

    results = ["n_words", "n_removed", "removed", "kept_text"]
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in results]
    own = free_name(docs.columns, "__own")
    hit, of, at, done = (f"{own}{k}" for k in range(4))
    key = _row_id(F.col(id_col), F.col(text_col))
    marked = with_likely(docs, hit, key, repeats, "id")
    text = F.col(text_col).cast("string")
    whole = marked.where(~F.col(hit)).select(*rest, finish(text, F.lit(None).cast("array<int>")).alias(done))
    places = repeats.select(F.col("id").alias(of), F.col("places").alias(at))
    cuts = marked.where(F.col(hit)).join(places, key == F.col(of), "left").select(*rest, finish(text, F.col(at)).alias(done))
    return whole.unionByName(cuts).select(*rest, *(F.col(f"{done}.{c}") for c in results))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the repeats of 20-word windows."""
    done = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
