"""N-gram Jaccard join by token-combination prefixes.

Every text becomes its set of distinct word shingles ("tokens" of the join). Two
sets with Jaccard similarity of at least p must share what their prefixes index:

1. A sketch of fixed size counts the tokens of all texts. It gives the global order
   (rare first) and the class of a token: rare, or frequent.
2. A set of n tokens may lose at most n - ceil(p n) of them. Its prefix runs until it
   holds one more "signature" than that: each rare token is one, and the c frequent
   tokens of one hash group are c - k + 1 (any fewer of them lost leaves k together).
   So a similar partner shares a rare token, or k frequent tokens of a group: indexed
   are single rare tokens and k-combinations of frequent ones.
3. Sets that share a signature are first compared with the smallest of them only, the
   leader (size bound, then a bitmap bound on the symmetric difference, then the exact
   sets); links contract to components. What still lies in different components is
   compared within the sets of a leader in blocks, with the same bounds and verification.
   So copies are never expanded into all pairs, and no link between components is lost.

Equal sets are one class before all this. Hashes have 64 bits.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matlink.llm.common import batches, bitmap, components, cut, prepare
from matlink.llm.wordvec import Words, mix, rolling, shingle_sets

SKETCH_BITS = 20
#: Bits of the bitmaps that are compared first, and of the largest.
_NARROW, _WIDEST = 512, 1 << 16
_SHARED_BITS = 24
_CHUNK = 1 << 16
#: Up to this many tokens a set's frequent ones form one hash group; each further size class is four times as wide.
_FIRST_CLASS = 128


def _spare(n: int, percent: int) -> int:
    """Signatures that a prefix must hold: one more than the tokens a similar partner may lack."""
    return n - -(-percent * n // 100) + 1


def _size_class(n: int) -> int:
    c, top = 0, _FIRST_CLASS
    while n > top:
        c, top = c + 1, top * 4
    return c


def _groups(size_class: int, percent: int) -> int:
    return 1 if size_class == 0 else max(1, _spare(_FIRST_CLASS * 4**size_class, percent) // 4)


def _combinations(tokens: np.ndarray, k: int) -> np.ndarray:
    at = np.array(list(combinations(range(len(tokens)), k)), np.int64).reshape(-1, k)
    out = np.full(len(at), np.uint64(k))
    for j in range(k):
        out = mix(out + tokens[at[:, j]])
    return out


def signatures(tokens: np.ndarray, level: np.ndarray, frequent: int, percent: int, k: int = 2) -> np.ndarray:
    """The index keys of a set: tokens are its hashes, level the rarity of each (0 is rarest)."""
    n = len(tokens)
    if n == 0:
        return tokens
    need = _spare(n, percent)
    order = np.lexsort((tokens, level))
    tokens, level = tokens[order], level[order]
    rare = int(np.searchsorted(level, frequent))
    singles = tokens[: min(rare, need)]
    if rare >= need:
        return singles
    out, rest, lack = [singles], tokens[rare:], need - rare
    largest = -(-100 * n // percent)  # tokens of the largest similar partner
    for size_class in range(_size_class(n), _size_class(largest) + 1):
        group = (rest >> np.uint64(13)) % np.uint64(_groups(size_class, percent))
        by = np.argsort(group, kind="stable")
        heads = np.flatnonzero(np.diff(group[by], prepend=group[by][0] + np.uint64(1)))
        rank = np.empty(len(rest), np.int64)
        rank[by] = np.arange(len(rest)) - np.repeat(heads, np.diff(heads, append=len(rest)))
        gained = np.cumsum(rank >= k - 1)
        c = int(np.searchsorted(gained, lack)) + 1
        chosen, salt = group[:c], np.uint64(size_class * 0x51ED2701 + 7)
        for g in np.unique(chosen):
            mine = np.sort(rest[:c][chosen == g])
            if len(mine) >= k:
                out.append(mix(_combinations(mine, k) ^ (salt + (g << np.uint64(20)))))
    return np.concatenate(out)


def _bits(tokens: np.ndarray, size: int) -> bytes:
    """Parity bitmap of a set: the Hamming distance of two is at most the size of the symmetric difference."""
    odd = (np.bincount((tokens % np.uint64(size)).astype(np.int64), minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd).tobytes()


def _wide_size(n: int) -> int:
    """Bits of a set's large bitmap, a power of two: a larger one folds to the size of a smaller one."""
    size = _NARROW
    while size < 8 * n and size < _WIDEST:
        size *= 2
    return size


def _distance(x: bytes, y: bytes) -> int:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _set_id(tokens: np.ndarray) -> int:
    both = np.array([tokens.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(tokens), initial=np.uint64(0)), np.uint64(len(tokens))])
    return int(rolling(both, 3).view(np.int64)[0])


def _words(texts: list) -> Words:
    return Words(texts, lower=True)


def _sketch(texts: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """Occurrences of all tokens in 2**SKETCH_BITS hash buckets; number of texts."""

    def count(frames):
        total, rows = np.zeros(1 << SKETCH_BITS, np.int64), 0
        for frame in frames:
            text = frame["text"].tolist()
            rows += len(text)
            for a, b in batches(text):
                w = _words(text[a:b])
                grams = rolling(w.hashes, words)
                total += np.bincount((grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        for part in range(0, len(total), _CHUNK):
            yield pd.DataFrame({"part": [part], "rows": [rows if not part else 0], "counts": [total[part : part + _CHUNK].astype("<i8").tobytes()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, "<i8") for x in frame["counts"]], axis=0)
        return pd.DataFrame({"part": frame["part"][:1], "rows": [frame["rows"].sum()], "counts": [total.tobytes()]})

    kind = "part int, rows long, counts binary"
    got = texts.select("text").mapInPandas(count, kind).groupBy("part").applyInPandas(add, kind).toPandas().sort_values("part")
    if not len(got):
        return np.zeros(1 << SKETCH_BITS, np.int64), 0
    return np.concatenate([np.frombuffer(x, "<i8") for x in got["counts"]]), int(got["rows"].sum())


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, k: int = 2, frequent_share: float = 0.002, block: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Similarity classes of all texts of docs.

    Returns (members, links). members: id, n_shingles, set_id, component_id (the smallest
    id that links reach), one row per input row. links: verified pairs (a, b) of set ids
    of different sets that connect the components; equal sets share a set_id.

    A text of fewer words than a shingle is one shingle; a null text, or one without
    words, has the empty set and links with nothing. Rows with a null id keep their row,
    with a null component_id of their own unless linked to a text with an id. Repeated
    ids are allowed. Other columns of docs are ignored, whatever their names.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch, rows = _sketch(texts, words)
    limit = max(32, frequent_share * rows, 4 * sketch.mean())
    frequent = int(np.ceil(np.log2(limit) * 8))
    levels = spark.sparkContext.broadcast(np.minimum(np.log2(np.maximum(sketch, 1)) * 8, 255).astype(np.uint8))

    def index(frames):
        level = levels.value
        for frame in frames:
            ids, text = frame["id"], frame["text"].tolist()
            for a, b in batches(text):
                out = []
                for tokens in shingle_sets(_words(text[a:b]), words):
                    sig = signatures(tokens, level[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], frequent, percent, k)
                    out.append((len(tokens), _set_id(tokens), np.unique(sig).view(np.int64), _bits(tokens, _NARROW), _bits(tokens, _wide_size(len(tokens)))))
                n, sid, sig, bits, wide = zip(*out, strict=True)
                yield pd.DataFrame({"id": ids.iloc[a:b].astype("Int64"), "n": n, "sid": sid, "sigs": sig, "bits": bits, "wide": wide})

    indexed = cut(texts.mapInPandas(index, "id long, n int, sid long, sigs array<long>, bits binary, wide binary"))
    info = indexed.where("n > 1").groupBy("sid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("wide").alias("wide"), F.min("id").alias("id"))
    info = cut(info)
    rows = indexed.where("n > 1").select(F.explode("sigs").alias("sig"), "sid")
    shared = cut(rows.groupBy("sig").agg(F.min("sid").alias("leader"), F.max("sid").alias("last")).where("leader < last").select("sig", "leader"))
    maybe = spark.sparkContext.broadcast(bitmap(shared, "sig", _SHARED_BITS, hashed=False))

    def among(frames):
        held = maybe.value
        for frame in frames:
            sid, sigs = frame["sid"].to_numpy(np.int64), frame["sigs"].tolist()
            if not sigs:
                continue
            sig = np.concatenate(sigs)
            bit = (sig.view(np.uint64) >> np.uint64(64 - _SHARED_BITS)).astype(np.int64)
            keep = ((held[bit >> 6] >> (bit & 63)) & 1).astype(bool)
            yield pd.DataFrame({"sig": sig[keep], "sid": np.repeat(sid, [len(x) for x in sigs])[keep]})

    held = indexed.where("n > 1").select("sid", "sigs").mapInPandas(among, "sig long, sid long").distinct()
    star = cut(held.join(shared, "sig").where("sid <> leader").select("sid", "leader").distinct())

    links = cut(_verified(texts, _bounded(star.select(F.col("sid").alias("a"), F.col("leader").alias("b")), info, percent), words, percent))
    label = components(links)

    def compare(frames, forest: bool):
        frames = [f for f in frames if len(f)]
        if not frames:
            return
        held = pd.concat(frames, ignore_index=True)
        order = np.lexsort((held["n"], held["key"]))
        key, sid, n, label, side = (held[c].to_numpy()[order] for c in ("key", "sid", "n", "label", "side"))
        bits = np.frombuffer(b"".join(held["bits"].to_numpy()[order]), np.uint64).reshape(-1, _NARROW // 64)
        wide = held["wide"].to_numpy()[order]
        found = set()
        edges = np.flatnonzero(np.diff(key, prepend=key[0] - 1, append=key[-1] + 1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a < 2 or (label[a:b] == label[a]).all():
                continue
            near = []
            tops = a + np.searchsorted(n[a:b], n[a:b] * 100 // percent, side="right")
            for i, to in zip(range(a, b - 1), tops.tolist(), strict=False):
                if to <= i + 1:
                    continue
                c = slice(i + 1, to)
                far = np.bitwise_count(bits[c] ^ bits[i]).sum(axis=1, dtype=np.int64)
                both = n[c] + n[i]
                most = both - 2 * _overlap(both, percent)
                ok = (label[c] != label[i]) & (far <= most) & ((side[c] != side[i]) | (side[i] == 2))
                for j in np.flatnonzero(ok).tolist():
                    x, y = wide[i], wide[i + 1 + j]
                    gap = most[j] - (far[j] if x is None or y is None else _distance(x, y))
                    if gap >= 0:
                        near.append((int(gap), i, i + 1 + j))
            for i, j in _forest(near, label) if forest else (x[1:] for x in near):
                found.add((min(int(sid[i]), int(sid[j])), max(int(sid[i]), int(sid[j]))))
        if found:
            yield pd.DataFrame(sorted(found), columns=["a", "b"])

    # All that share a signature share its leader, so the sets of a leader hold every pair that is left.
    # More than block sets of one are compared as pairs of chunks: a set goes to each pair of its chunk.
    # The likeliest pairs that would connect a chunk come first; then all pairs that are still apart.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    for forest in (True, False):
        apart = star.join(label.withColumnRenamed("node", "sid"), "sid", "left").select("leader", "sid", F.coalesce("component", "sid").alias("label"))
        sizes = apart.groupBy("leader").agg(F.count("*").alias("cnt"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("leader", "cnt")
        chunks = F.ceil(F.col("cnt") / block).cast("int")
        mine = F.pmod(F.xxhash64("sid"), chunks).cast("int")
        spread = F.when(F.col("cnt") <= block, F.expr("array(0)")).otherwise(F.sequence(F.lit(0), chunks - 1))
        pieces = (
            apart.join(sizes, "leader")
            .select("leader", "sid", "label", mine.alias("mine"), F.explode(spread).alias("other"))
            .join(info.select("sid", "n", "bits", F.when(F.col("n") <= 512, F.col("wide")).alias("wide")), "sid")
            .select(
                F.xxhash64("leader", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"),
                "sid",
                F.col("n").cast("long").alias("n"),
                "label",
                F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
                "bits",
                "wide",
            )
        )
        more = pieces.repartition(parts, "key").mapInPandas(partial(compare, forest=forest), "a long, b long").distinct()
        links = cut(links.unionByName(_verified(texts, _bounded(more, info, percent), words, percent)).distinct())
        label = components(links)

    members = indexed.select("id", "n", "sid").join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("component", "sid"))
    smallest = members.where("n > 0").groupBy("label").agg(F.min("id").alias("component_id"))
    members = members.join(smallest, "label", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("sid").alias("set_id"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return members, links


def _forest(near: list[tuple[int, int, int]], label: np.ndarray) -> list[tuple[int, int]]:
    """Of pairs (gap, i, j), those of the largest gaps that connect what all of them connect; a label is connected."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for _, i, j in sorted(near, key=lambda x: (-x[0], x[1], x[2])):
        x, y = find(int(label[i])), find(int(label[j]))
        if x != y:
            root[x] = y
            kept.append((i, j))
    return kept


def _overlap(both, percent: int):
    """The smallest overlap of two sets of so many tokens in all: 100 o >= percent (both - o)."""
    return -(-percent * both // (100 + percent))


def _bounded(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the size and bitmap bounds, with their sizes and documents."""
    for side in "ab":
        pairs = pairs.join(info.select(F.col("sid").alias(side), F.col("n").alias(f"n{side}"), F.col("id").alias(f"id_{side}")), side)
    pairs = pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    for side in "ab":
        pairs = pairs.join(info.select(F.col("sid").alias(side), F.col("wide").alias(f"w{side}")), side)

    def near(frames):
        for frame in frames:
            far = np.fromiter((_distance(x, y) for x, y in zip(frame.pop("wa"), frame.pop("wb"), strict=True)), np.int64, len(frame))
            both = (frame["na"] + frame["nb"]).to_numpy(np.int64)
            for c in ("id_a", "id_b"):
                frame[c] = frame[c].astype("Int64")
            yield frame[far <= both - 2 * _overlap(both, percent)]

    return pairs.select("a", "b", "na", "nb", "id_a", "id_b", "wa", "wb").mapInPandas(near, "a long, b long, na int, nb int, id_a long, id_b long")


def _verified(texts: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs whose sets, made again from the texts, are similar enough."""
    pairs = cut(pairs)
    spark = pairs.sparkSession
    sides = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    ids = pairs.select(F.col("id_a").alias("id")).unionByName(pairs.select(F.col("id_b").alias("id"))).where("id is not null")
    wanted = spark.sparkContext.broadcast(bitmap(ids, "id"))
    log2 = 23

    def sets(frames):
        held = wanted.value
        for frame in frames:
            bit = frame["bit"].to_numpy(np.int64)
            keep = ((held[bit >> 6] >> (bit & 63)) & 1).astype(bool) | frame["no_id"].to_numpy(bool)
            text = frame["text"][keep].tolist()
            for a, b in batches(text):
                made = [(_set_id(t), t.view(np.int64)) for t in shingle_sets(_words(text[a:b]), words) if len(t)]
                if made:
                    yield pd.DataFrame({"sid": [x[0] for x in made], "tokens": [x[1] for x in made]})

    bit = F.shiftrightunsigned(F.xxhash64("id"), 64 - log2)
    made = texts.select("text", bit.alias("bit"), F.col("id").isNull().alias("no_id")).mapInPandas(sets, "sid long, tokens array<long>")
    made = made.join(sides, "sid", "left_semi").groupBy("sid").agg(F.first("tokens").alias("tokens"))
    a, b = (made.select(F.col("sid").alias(c), F.col("tokens").alias(f"tokens_{c}")) for c in "ab")
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return pairs.join(a, "a").join(b, "b").where(both * 100 >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents under 85 % Jaccard similarity of 4-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    members, _ = jaccard_classes(docs, words=4, percent=85)
    return members.select("doc_id", "n_shingles", "component_id")
