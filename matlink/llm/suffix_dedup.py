"""Suffix-array dedup: every byte that a repeated window of bytes covers is removed, wherever it stands.

1. Hashed anchors (the least of each run of byte n-grams, chosen by content alone) that have one
   start only rule out all windows around them: equal windows choose equal anchors.
2. What is left is cut into regions, runs of windows with the same least n-gram, and dealt by range
   on (that n-gram, the region): equal windows have equal least n-grams, so their regions are neighbours,
   and an n-gram that a third of all texts holds is spread over as many partitions as it needs.
3. A shard is a few megabytes of regions. Its suffix array is made in numpy by Larsson-Sadakane
   refinement up to the window's length: only groups that are still equal are sorted again, by the
   ranks half as deep. Kasai's common prefixes then give the classes of equal windows.
4. Shards that split an n-gram between them send a sorted key for each of its windows; these arrays are merged
   by binary search, and windows that another shard also holds are reported, too.
5. Reports go back to the texts, which drop the bytes that reported windows cover.

Windows of a shard are compared byte by byte; anchors and windows across shards trust 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matlink.llm.common import buckets_for, cut, prepare, release, with_likely
from matlink.llm.substring_dedup import _ROWS, _Starts, _by_bucket, _frame, _repeats, _runs
from matlink.llm.wordvec import _BYTE, mix, rolling

#: Bytes of text that are hashed at a time, and of regions in a shard.
_PIECE, _SHARD = 1 << 20, 1 << 20
#: Bytes of text, or of regions, that a task gets.
_TASK_BYTES = 64 << 20
_HELD = 400_000
_LANES = 1 << 14
#: Places of one region that a shard holds; further ones are reported at once.
_COPIES = 100_000


def slide(v: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum, np.maximum) of all width consecutive values."""
    size, out = 1, v
    while 2 * size <= width:
        out, size = best(out[:-size], out[size:]), 2 * size
    return best(out[: len(out) - (width - size)], out[width - size :]) if size < width else out


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of the bytes s, sorted by their first depth bytes."""
    n = len(s)
    words = _words(s, 0)
    if depth < 8:
        words = words >> np.uint64(8 * (8 - depth))
    order = np.argsort(words).astype(np.int32)
    words = words[order]
    head = np.concatenate([[True], words[1:] != words[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0))
    done = min(8, depth)
    while done < depth:
        step = min(done, depth - done)
        last = np.concatenate([head[1:], [True]])
        open_ = np.flatnonzero(~(head & last))  # places in groups of two and more
        if not len(open_):
            break
        p = order[open_]
        after = p + step
        behind = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = (rank[p].astype(np.int64) << 32) | behind
        by = np.argsort(key)
        key, p = key[by], p[by]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        order[open_], head[open_] = p, fresh
        rank[p] = np.maximum.accumulate(np.where(fresh, open_, 0))
        done += step
    return order


def _words(s: np.ndarray, pad: int) -> np.ndarray:
    """The eight bytes at each place as a number that sorts as they do; zeros behind the end."""
    whole = np.concatenate([s, np.zeros(pad + 8, np.uint8)])
    out = np.zeros(len(s) + pad, np.uint64)
    for k in range(8):
        out |= whole[k : k + len(out)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def common_prefixes(s: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix, depth at most, of each suffix with the one before it (Kasai et al. 2001).

    order: the suffixes of s, or some of them, sorted by their first depth bytes. They are gone through
    by place, in lanes side by side: the prefix of the next suffix is one shorter at
    least, so each lane goes on from where it was.
    """
    n, m = len(s), len(order)
    words = _words(s, depth)
    at = np.full(n + 1, m, np.int32)  # of a suffix that isn't in order: behind all
    at[order] = np.arange(m, dtype=np.int32)
    places = np.flatnonzero(at < m)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    out = np.zeros(m, np.int32)
    length = -(-m // min(_LANES, max(m, 1)))
    lanes = np.arange(0, m, max(length, 1))
    h = np.zeros(len(lanes), np.int64)
    for t in range(length):
        if len(lanes) and lanes[-1] + t >= m:
            lanes, h = lanes[:-1], h[:-1]
        p = places[lanes + t]
        q = before[p].astype(np.int64)
        h = np.where(q >= 0, h, 0)
        most = np.minimum(depth, n - np.maximum(p, q))
        go = np.flatnonzero((q >= 0) & (h < most))
        while len(go):
            now = h[go]
            same = 8 - np.searchsorted(_BYTES, words[p[go] + now] ^ words[q[go] + now], side="right")
            h[go] = now = np.minimum(now + same, most[go])
            go = go[(same == 8) & (now < most[go])]
        out[at[p]] = h
        # one shorter, if the suffix after q also stands before the one after p; of equal ones it may not
        after = at[p + 1]
        h = np.where((q >= 0) & (after < m) & (at[q + 1] < after), np.maximum(h - 1, 0), 0)
    return out


#: A number of eight bytes below the k-th has 8 - k zero bytes at its head.
_BYTES = np.array([1 << 8 * k for k in range(8)], np.uint64)


class _Texts:
    """Pieces of texts as one array of bytes; a piece starts row's text at start, and overlaps the next by window - 1."""

    def __init__(self, rows: list[tuple[int, int, bytes]]):
        self.row = np.array([r[0] for r in rows])
        self.start = np.array([r[1] for r in rows])
        sizes = np.array([len(r[2]) for r in rows])
        self.data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        self.ends = np.cumsum(sizes)
        self.offsets = self.ends - sizes
        self.left = np.repeat(self.ends, sizes) - np.arange(len(self.data))

    def piece(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")


def _texts(texts: list, window: int) -> Iterator[_Texts]:
    """Texts of a window and more, in runs of pieces of near _PIECE bytes in all."""
    held, size = [], 0
    for i, t in enumerate(texts):
        data = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t
        if data is None or len(data) < window:
            continue
        for a in range(0, len(data) - window + 1, _PIECE):
            part = data[a : a + _PIECE + window - 1]
            if held and size + len(part) > _PIECE:
                yield _Texts(held)
                held, size = [], 0
            held.append((i, a, part))
            size += len(part)
    if held:
        yield _Texts(held)
    release()


class _Grams:
    """Hashes of n-grams of pieces, and the least of each reach of them that lies in one piece."""

    def __init__(self, texts: _Texts, gram: int, reach: int):
        self.hashes = rolling(_BYTE[texts.data], gram)
        self.least = slide(self.hashes, reach, np.minimum)
        self.least[texts.left[: len(self.least)] < gram + reach - 1] = 0

    def anchors(self, reach: int) -> np.ndarray:
        """Places of n-grams that are the least of a reach."""
        edge = np.zeros(reach - 1, np.uint64)
        top = slide(np.concatenate([edge, self.least, edge]), reach, np.maximum)
        return np.flatnonzero((self.hashes == top) & (top > 0))


def _row_key(id_col: Column, text: Column) -> Column:
    return F.xxhash64(id_col.cast("string"), text)


def _compare(regions: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a shard's regions: their place in it, their region, their class."""
    s = np.frombuffer(b"".join(regions), np.uint8)
    sizes = np.fromiter(map(len, regions), np.int64, len(regions))
    owner = np.repeat(np.arange(len(regions)), sizes)
    starts = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(s)) >= window
    order = suffix_array(s, window)
    order = order[starts[order]]
    return order, owner[order], np.cumsum(common_prefixes(s, order, window) < window)


class _Split:
    """Sorted keys of windows that other shards may hold, by buckets: key, row, place, is it repeated."""

    KIND = np.dtype([("h", "<u8"), ("row", "<i8"), ("place", "<i4"), ("many", "?")])

    def __init__(self, buckets: int):
        self.buckets = buckets

    def give(self, windows: np.ndarray):
        windows = np.sort(windows, order="h")
        head = np.flatnonzero(np.concatenate([[True], windows["h"][1:] != windows["h"][:-1]]))
        many = np.logical_or.reduceat(windows["many"], head) | (np.diff(head, append=len(windows)) > 1)
        windows = windows[head]
        windows["many"] = many
        bucket = (mix(windows["h"].copy()) % np.uint64(self.buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        yield from ((b, windows[by][x].tobytes()) for b, x in _runs(bucket[by]))

    @classmethod
    def merge(cls, packed: list[bytes]) -> np.ndarray:
        """All windows of a bucket that occur twice; sorted arrays are merged by pairs, by binary search."""
        held = [np.frombuffer(p, cls.KIND).copy() for p in packed]
        found = []
        while len(held) > 1:
            a, b = held.pop(0), held.pop(0)
            at = np.searchsorted(a["h"], b["h"])
            same = a["h"][np.minimum(at, len(a) - 1)] == b["h"]
            a["many"][at[same]] = True
            found.append(b[same])
            held.append(np.insert(a, at[~same], b[~same]))
        return np.concatenate([*found, held[0][held[0]["many"]]])


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, shard: int = _SHARD) -> DataFrame:
    """docs with n_bytes, n_removed, removed (byte spans start, end) and kept (remaining bytes).

    Texts are UTF-8 bytes. A window is window consecutive bytes of one text; all bytes are removed
    that lie in a window that starts anywhere else, too, in the same text or another, in all of its
    places. A text of fewer bytes than a window keeps all; a null text is empty. Rows of the same
    id are texts of their own, so repeated rows remove each other; rows with a null id
    are texts like others. Rows are told apart by a 64-bit hash of id and text. shard: bytes of
    regions whose suffixes are sorted at a time.
    Columns of docs with the name of a result are replaced; others are kept.
    """
    if window < 1:
        raise ValueError("a window has one byte at least")
    spark = docs.sparkSession
    prepare(spark)
    gram, reach = max(1, window // 8), max(1, window // 3)
    span, whole = gram + reach - 1, window - gram + 1
    text = F.col(text_col).cast("string")
    texts = docs.select(_row_key(F.col(id_col), text).alias("id"), text.alias("text")).where(F.octet_length("text") >= window)
    parts = buckets_for(texts, "text", max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), _TASK_BYTES)

    def anchors(frames):
        out = _Starts(2 * parts, first_only=False)
        for frame in frames:
            ids = frame["id"].to_numpy(np.int64)
            for t in _texts(frame["text"].tolist(), window):
                grams = _Grams(t, gram, reach)
                at = grams.anchors(reach)
                piece = t.piece(at)
                out.add(grams.hashes[at], ids[t.row[piece]], (at - t.offsets[piece] + t.start[piece]).astype(np.int32))
                yield from out.give(_HELD)
        yield from out.give()

    near = cut(_repeats(texts.mapInPandas(anchors, _ROWS), 2 * parts, parts, first_only=False))

    def regions(frames):
        held, size = {}, 0

        def give():
            rows = [(m, r, list(k), list(p)) for (m, r), (k, p) in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["gram", "region", "rows", "places"])

        for frame in frames:
            ids, places = frame["id"].to_numpy(np.int64), frame["places"].tolist()
            for t in _texts(frame["text"].tolist(), window):
                grams = _Grams(t, gram, reach)
                known = []
                for row, start, lo, hi in zip(t.row.tolist(), t.start.tolist(), t.offsets.tolist(), t.ends.tolist(), strict=True):
                    at = np.asarray(places[row], np.int64) - start
                    known.append(at[(at >= 0) & (at <= hi - lo - gram)] + lo)
                known = np.unique(grams.hashes[np.concatenate(known)])
                head = np.flatnonzero(np.concatenate([[True], grams.least[1:] != grams.least[:-1]]))
                value = grams.least[head]
                alone = known[np.minimum(np.searchsorted(known, value), len(known) - 1)] != value if len(known) else np.ones(len(value), bool)
                alone = np.repeat(alone, np.diff(head, append=len(grams.least)))
                before = np.concatenate([[0], np.cumsum(alone)])
                inner = window - span + 1
                ok = (before[inner:] == before[:-inner]) & (t.left[: len(before) - inner] >= window)
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                first = slide(grams.hashes, whole, np.minimum)[at]
                cuts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (first[1:] != first[:-1])]))
                place = np.arange(len(at)) - np.repeat(cuts, np.diff(cuts, append=len(at)))
                cuts = np.flatnonzero(place % whole == 0)
                lo, n = at[cuts], np.diff(cuts, append=len(at))
                piece = t.piece(lo)
                data = t.data.tobytes()
                key = mix(first[cuts]).view(np.int64).tolist()
                own, start = ids[t.row[piece]].tolist(), (lo - t.offsets[piece] + t.start[piece]).tolist()
                for m, a, b, i, p in zip(key, lo.tolist(), (lo + n + window - 1).tolist(), own, start, strict=True):
                    got = held.setdefault((m, data[a:b]), ([], []))
                    got[0].append(i)
                    got[1].append(p)
                    size += b - a
                if size > 4 * shard:
                    yield give()
                    size = 0
        if held:
            yield give()

    touched = with_likely(texts, "__hit", F.col("id"), near, "id").where("__hit").drop("__hit").join(near, "id").select("id", "text", "places")
    found = cut(touched.mapInPandas(regions, "gram long, region binary, rows array<long>, places array<int>"))
    size = found.agg(F.sum(F.octet_length("region"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // _TASK_BYTES), 1)

    def shards(frames):
        """Reports (row, low, high) of runs of repeated window starts, and packed keys of windows of split n-grams."""
        split = _Split(2 * tasks)

        def reports(ids: np.ndarray, low: np.ndarray, high: np.ndarray):
            for k in range(0, len(ids), _COPIES):
                part = slice(k, k + _COPIES)
                yield pd.DataFrame({"id": ids[part], "low": low[part].astype(np.int32), "high": high[part].astype(np.int32), "bucket": None, "packed": None})

        def judge(rows: list[tuple], open_: set):
            keys, texts, ids, places = zip(*rows, strict=True)
            copies = np.array([sum(map(len, x)) for x in ids])
            heads = np.cumsum(copies) - copies
            ids, places = (np.concatenate([a for x in of for a in x]).astype(np.int64) for of in (ids, places))
            at, owner, group = _compare(list(texts), window)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            _, group = np.unique(group, return_inverse=True)
            many = np.bincount(group, copies[owner])[group] > 1
            offset = at - (np.cumsum(sizes) - sizes)[owner]
            by = np.lexsort((offset[many], owner[many]))
            o, f = owner[many][by], offset[many][by]
            if len(o):
                first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (f[1:] != f[:-1] + 1)]))
                last = np.append(first[1:], len(o)) - 1
                n = copies[o[first]]  # each run is reported to all places of its region
                run = np.repeat(np.arange(len(first)), n)
                mine = heads[o[first]][run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
                yield from reports(ids[mine], places[mine] + f[first][run], places[mine] + f[last][run] + 1)
            shared = np.fromiter((k in open_ for k in keys), bool, len(keys))[owner]
            if shared.any():
                data = np.frombuffer(b"".join(texts), np.uint8)
                windows = np.empty(int(shared.sum()), _Split.KIND)
                windows["h"] = rolling(_BYTE[data], window)[at[shared]]
                windows["row"] = ids[heads[owner[shared]]]
                windows["place"] = places[heads[owner[shared]]] + offset[shared]
                windows["many"] = many[shared]
                yield pd.DataFrame([(None, None, None, b, p) for b, p in split.give(windows)], columns=["id", "low", "high", "bucket", "packed"])
            release()

        rows, size, open_, kept, held = [], 0, set(), 0, 0  # kept: rows of whole n-grams among rows; held: places of the last row
        first = True
        for frame in frames:
            for gram_, region, ids, places in zip(frame["gram"].tolist(), frame["region"].tolist(), frame["rows"].tolist(), frame["places"].tolist(), strict=True):
                if first:
                    open_.add(gram_)  # the partition before may hold it, too
                    first = False
                if rows and rows[-1][0] == gram_ and rows[-1][1] == region:  # sorted once, for all of its places
                    if held < _COPIES:
                        rows[-1][2].append(ids)
                        rows[-1][3].append(places)
                        held, size = held + len(ids), size + 12 * len(ids)
                    else:
                        yield from reports(np.asarray(ids), np.asarray(places), np.asarray(places) + len(region) - window + 1)
                    continue
                if rows and rows[-1][0] != gram_:
                    kept = len(rows)
                if size + len(region) > shard and rows:
                    if not kept:
                        kept = len(rows)
                        open_ |= {gram_, rows[-1][0]}
                    yield from judge(rows[:kept], open_)
                    rows, kept = rows[kept:], 0
                    size = sum(len(r[1]) + 12 * sum(map(len, r[2])) for r in rows)
                    open_ &= {gram_, *(r[0] for r in rows[:1])}
                rows.append((gram_, region, [ids], [places]))
                held, size = len(ids), size + len(region) + 12 * len(ids)
        if rows:
            open_.add(rows[-1][0])  # and the partition behind
            yield from judge(rows, open_)

    kind = "id long, low int, high int, bucket int, packed binary"
    keys = ["gram", "h", "first"]  # the last lets a region of many copies go to several partitions
    dealt = found.withColumns({"h": F.xxhash64("region"), "first": F.col("rows")[0]}).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    judged = cut(dealt.select("gram", "region", "rows", "places").mapInPandas(shards, kind))

    def across(frames):
        def judge(packed: list[bytes]):
            w = _Split.merge(packed)
            yield pd.DataFrame({"id": w["row"].astype(np.int64), "low": w["place"].astype(np.int32), "high": (w["place"] + 1).astype(np.int32)})

        yield from _by_bucket(frames, judge)

    split = judged.where("packed is not null").select("bucket", F.lit(False).alias("report"), "packed")
    more = split.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInPandas(across, "id long, low int, high int")
    reports = judged.where("id is not null").select("id", "low", "high").unionByName(more)
    again = texts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(0).alias("low"), F.lit(2**31 - 1).alias("high"))
    hits = cut(reports.unionByName(again).groupBy("id").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high")))

    @F.pandas_udf("n_bytes long, n_removed long, removed array<struct<start:int,end:int>>, kept binary")
    def finish(texts: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        rows = []
        for t, a, b in zip(texts.tolist(), low.tolist(), high.tolist(), strict=True):
            data = (t or "").encode("utf-8", "surrogatepass")
            spans = []
            if a is not None and len(data) >= window:
                for x, y in sorted(zip(np.asarray(a).tolist(), np.asarray(b).tolist(), strict=True)):
                    y = min(y + window - 1, len(data))
                    if spans and x <= spans[-1][1]:
                        spans[-1][1] = max(y, spans[-1][1])
                    else:
                        spans.append([x, y])
            kept, at = [], 0
            for x, y in spans:
                kept.append(data[at:x])
                at = y
            kept = b"".join([*kept, data[at:]])
            rows.append((len(data), len(data) - len(kept), [{"start": x, "end": y} for x, y in spans], kept))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "removed", "kept"])

    results = ["n_bytes", "n_removed", "removed", "kept"]
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), _row_key(F.col(id_col), text).alias("key"), text.alias("body"))
    marked = with_likely(inner, "hit", F.col("key"), hits, "id")
    none = F.lit(None).cast("array<int>")
    clean = marked.where("not hit").select("doc", finish("body", none, none).alias("done"))
    cuts = marked.where("hit").join(hits, F.col("key") == F.col("id"), "left").select("doc", finish("body", "low", "high").alias("done"))
    rest = [F.col("doc")[c].alias(c) for c in docs.columns if c not in results]
    return clean.unionByName(cuts).select(*rest, *(F.col("done")[c].alias(c) for c in results))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 400-byte strings that start elsewhere, too."""
    done = dedup_suffixes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
