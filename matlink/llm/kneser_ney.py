"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

1. The words of trusted texts are counted, and numbered by falling frequency: most tokens are small
   numbers then, which compress well. The words lie in the shared folder, where tasks read them:
   the driver doesn't hold them.
2. Trigrams are counted in shards by their middle word: a task sums up its own before it sends
   them. So a shard has all trigrams u v w, contexts u v, bigrams v w and contexts v of its words
   v, and all that discounting needs but a few totals. The counts that give the words their
   probabilities and back-off weights lie in the shared folder, too. Only totals, the weights of
   a fixed number of contexts, bigrams and trigrams that are often met, and three bitmaps of fixed
   size of all of them pass through the driver and are broadcast. The model is fitted on all
   trusted labelled rows (a caller may bound them by `most_rows`, `most_chars`). More text makes
   more shards; what is broadcast keeps its size, the words in a task grow with the vocabulary.
3. A token w after u v of any text needs its shard only if its context, bigram or trigram may be
   in the model and isn't one that is often met.
   These tokens are joined with the shards, packed by bucket: a bucket is a shard and a salt
   by text, so more text makes more buckets. All other tokens are scored in place.
4. The sums of each text's logarithms are added up by text, as whole numbers: in any order of
   the shards they give the same sum.

A text is kept if its perplexity doesn't exceed a quantile of that of trusted texts of its
language that the model hasn't seen.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matlink.llm.common import batches, buckets_for, cut, prepare, release, shared_dir, with_likely
from matlink.llm.warc import open_store
from matlink.llm.wordvec import Words, mix

_BEGIN, _END = np.uint64(0x0B5B5B5B5B5B5B5B), np.uint64(0x0E4E4E4E4E4E4E4E)
_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: log10 of the probability of each letter of an unknown word.
_LETTER = -math.log10(32)
#: Shards (a power of two) at least and at most, and bytes of text that are counted to a shard.
_SHARDS, _MOST_SHARDS, _SHARD_BYTES = 16, 1 << 14, 8 << 20
#: Bits of the bitmaps of all shards, as a power of two.
_BITS = 26
#: The most frequent contexts, bigrams and trigrams (of each) of all shards whose weights are broadcast.
_OFTEN = 1 << 18
_HELD = 1_500_000
#: Bytes of text to a bucket of tokens.
_BUCKET_BYTES = 64 << 20
#: Logarithms are summed up as multiples of its inverse.
_UNIT = float(1 << 30)


def _zip(x: np.ndarray) -> bytes:
    """An array's bytes, the first of all values and then the second ones, compressed, and their number before them."""
    data = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True) if data else b""


def _unzip(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", "u1")
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _zip_steps(x: np.ndarray) -> bytes:
    """As _zip, the differences of values that mostly ascend."""
    return _zip(np.diff(x, prepend=x.dtype.type(0)))


def _unzip_steps(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(_unzip(data, kind), dtype=kind)


def _tokens(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens (words, then an end) of some texts; the words' lengths; where texts begin."""
    words = Words(texts, lower=True)
    first = words.first + np.arange(len(words.first))
    w = np.insert(words.hashes, words.first[1:], _END)
    return w, np.insert(words.ends - words.starts, words.first[1:], 0), first


def _units(logs: np.ndarray) -> np.ndarray:
    """Logarithms as whole multiples of 1 / _UNIT."""
    return np.rint(logs * _UNIT).astype(np.int64)


def _before(x: np.ndarray, first: np.ndarray, begin) -> np.ndarray:
    """The value before each one in its text; begin for the first."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first[:-1]] = begin
    return out


def _shard(v: np.ndarray, shards: int) -> np.ndarray:
    """Numbers follow frequencies, so each shard has frequent and rare words."""
    return v.astype(np.int64) % shards


def _own_bits(shards: int) -> int:
    """Bits of a shard's bitmaps, as a power of two."""
    return _BITS - (shards.bit_length() - 1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a.astype(np.uint64) * _M1 + b.astype(np.uint64) * _M2)


def _bit(pair: np.ndarray, shard: np.ndarray | int, bits: int) -> np.ndarray:
    """The place of a pair of words (or of a pair and a word) in the bitmaps of all shards, of 2**bits each."""
    return (pair >> np.uint64(64 - bits)).astype(np.int64) + (np.int64(shard) << bits)


def _held(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Which bits a packed bitmap has."""
    return (bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0


def _off(c: np.ndarray, d: tuple) -> np.ndarray:
    """The discount of counts of one, two, and three or more."""
    return np.array([0.0, *d])[np.minimum(c, 3)]


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts, from the numbers of n-grams with counts of one to four."""
    if not all(n[:3]):
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(float(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k)) for k in (1, 2, 3))


def _heads(*x: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    new = np.zeros(len(x[0]), bool)
    new[:1] = True
    for a in x:
        new[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(new)


def _summed(held: list[tuple]) -> tuple[np.ndarray, ...]:
    """Distinct (u, v, w) by v, w, u, and their counts."""
    u, v, w, c = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((u, v.astype(np.uint64) << np.uint64(32) | w))
    u, v, w, c = u[order], v[order], w[order], c[order]
    head = _heads(v, w, u)
    return u[head], v[head], w[head], np.add.reduceat(c, head).astype("<u4") if len(head) else c


def _zip_counts(u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[bytes, ...]:
    return _zip(u), _zip_steps(v), _zip_steps(w), _zip(c)


def _unzip_counts(u: bytes, v: bytes, w: bytes, c: bytes) -> tuple[np.ndarray, ...]:
    return _unzip(u, "<u4"), _unzip_steps(v, "<u4"), _unzip_steps(w, "<u4"), _unzip(c, "<u4")


def _put(df: DataFrame) -> str:
    """The folder of shared files in which the rows of df are now."""
    path = f"{shared_dir(df.sparkSession)}/kneser_ney-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def _rows(path: str) -> list[dict]:
    """The rows of _put, by their part."""
    store, folder = open_store(path)
    return pq.read_table(folder, filesystem=store, partitioning=None).sort_by("part").to_pylist()


class _Words:
    """Hashes of words, sorted, and their numbers: from 1, by falling frequency; 0 for others."""

    def __init__(self, path: str):
        rows = _rows(path)
        self.keys = np.concatenate([np.empty(0, "<u8"), *(_unzip_steps(r["keys"], "<u8") for r in rows)])
        n = np.concatenate([np.empty(0, "<u4"), *(_unzip(r["n"], "<u4") for r in rows)])
        self.ids = np.empty(len(n), np.uint32)
        self.ids[np.argsort(-n.astype(np.int64), kind="stable")] = np.arange(1, len(n) + 1)

    def find(self, key: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(key), np.uint32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ids[at], np.uint32(0))


@lru_cache(1)
def _words(path: str) -> _Words:
    """Once a worker."""
    return _Words(path)


@dataclass
class _Table:
    """Sorted keys and a value for each, and one for all others at the place 0."""

    keys: np.ndarray
    values: np.ndarray
    absent: float

    @cached_property
    def all(self) -> np.ndarray:
        return np.concatenate([[self.absent], self.values])

    def __getstate__(self):
        return _zip_steps(self.keys), _zip(self.values), self.absent

    def __setstate__(self, state):
        self.keys, self.values, self.absent = _unzip_steps(state[0], "<u8"), _unzip(state[1], "<f8"), state[2]

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, from 1; 0 for keys that are absent."""
        if not len(self.keys):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at + 1, 0)


@dataclass
class Lexicon:
    """What is broadcast: folders of the words and of their sums, discounts, totals, and of contexts,
    bigrams and trigrams the weights of those that are often met, and bitmaps (packed) of all."""

    words: str
    sums: str
    size: int
    d1: tuple
    d2: tuple
    d3: tuple
    total: int
    unknown: float
    often: list[_Table]
    bitmaps: np.ndarray
    shards: int

    @cached_property
    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Probability and back-off weight of the words, by their numbers; of an unknown one at 0."""
        p, g = np.zeros(self.size + 1), np.ones(self.size + 1)
        for r in _rows(self.sums):
            n, s = _unzip(r["n"], "<u4"), _unzip(r["sums"], "<u4").reshape(4, -1)
            p[r["part"] :: self.shards] = np.where(n > 0, (n - _off(n, self.d1)) / max(self.total, 1) + self.unknown, 0.0)  # the begin is no word
            g[r["part"] :: self.shards] = np.where(s[0] > 0, np.array(self.d2) @ s[1:] / np.maximum(s[0], 1), 1.0)
        p[0], g[0] = self.unknown, 1.0
        return p, g

    @property
    def p(self) -> _Table:
        """Probabilities by hash."""
        words = _words(self.words)
        return _Table(words.keys, self.weights[0][words.ids], self.unknown)


class _Shard:
    """Probabilities of the trigrams and bigrams of a shard, and weights of their contexts."""

    def __init__(self, lex: Lexicon, u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray):
        self.p, self.g = lex.weights
        u, v, w = (x.astype(np.int64) for x in (u, v, w))
        head = _heads(v, w)
        n, of = np.diff(head, append=len(v)), v[head]
        own, at = np.unique(of, return_inverse=True)
        self.bigrams = _Table(of << 32 | w[head], (n - _off(n, lex.d2)) / np.bincount(at, n, len(own))[at], 0.0)
        key, back = np.unique(u << 32 | v, return_inverse=True)
        total = np.bincount(back, c, len(key))
        self.contexts = _Table(key, np.bincount(back, _off(c, lex.d3), len(key)) / np.maximum(total, 1), 1.0)
        key = (back + 1) << 32 | w
        order = np.argsort(key)
        self.trigrams = _Table(key[order], ((c - _off(c, lex.d3)) / total[back])[order], 0.0)

    def log10(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        u, v, w = (x.astype(np.int64) for x in (u, v, w))
        low = self.p[w] * self.g[v] + self.bigrams.all[self.bigrams.find(v << 32 | w)]
        at = self.contexts.find(u << 32 | v)
        return np.log10(low * self.contexts.all[at] + self.trigrams.all[self.trigrams.find(at << 32 | w)])


@dataclass
class Model:
    """lexicon is broadcast, shards are joined: (shard, u, v, w, c), packed."""

    lexicon: Lexicon
    shards: DataFrame

    @property
    def tables(self) -> dict[str, _Table]:
        return {"w": self.lexicon.p}

    @property
    def unknown(self) -> float:
        return self.lexicon.unknown

    def log10(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens and log10 probability of each of a few texts."""
        rows = self.shards.sparkSession.createDataFrame(list(enumerate(texts)), "id long, text string")
        got = perplexity(rows, self, ["id"]).toPandas().sort_values("id")
        return got["n_tokens"].to_numpy(), got["log10"].to_numpy()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int | None = None, most_chars: int | None = None, among: DataFrame | None = None) -> Model:
    """A trigram model of all texts whose ids are in the first column of among (all, without it).

    A repeated row counts once. Null texts are left out. Without any text every token is unknown.
    With most_rows or most_chars, only that many rows, of that many characters in all, of the
    lowest hashes of id and text.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__of"), F.col(text_col).cast("string").alias("text")).withColumn("hash", F.xxhash64("__of", "text"))
    found = rows.select("__of", "hash", F.char_length("text").alias("n"))
    if among is not None:
        found = found.join(among.select(F.col(among.columns[0]).alias("__id")).distinct(), F.col("__of") == F.col("__id"), "left_semi")
    found = found.groupBy("hash").agg(F.max("n").alias("n"))
    if most_rows is not None:
        found = found.orderBy("hash").limit(most_rows)
    if most_chars is not None:
        found = found.withColumn("all", F.sum("n").over(Window.orderBy("hash"))).where(F.col("all") <= most_chars)
    found = cut(found.select("hash", "n"))
    size = found.agg(F.sum("n")).first()[0] or 0
    shards = min(max(_SHARDS, 1 << (-(-size // _SHARD_BYTES) - 1).bit_length() if size else 1), _MOST_SHARDS)
    bits, most_often = _own_bits(shards), _OFTEN // shards
    # rows that are surely among these, and once only, aren't shuffled: their bit is set, and no other row has it
    others = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("copies")).join(found.select("hash", F.lit(True).alias("learned")), "hash", "left").where("learned is null or copies > 1").select("hash")
    marked = with_likely(with_likely(rows, "likely", F.col("hash"), found, "hash").where("likely"), "doubtful", F.col("hash"), others, "hash", 24)
    texts = marked.where("not doubtful").select("text").unionByName(marked.where("doubtful").join(found, "hash", "left_semi").dropDuplicates(["hash"]).select("text"))
    high = np.uint64(64 - (shards.bit_length() - 1))

    def words(frames):
        """The words of a task's texts with their numbers, by their hashes' first bits."""
        held, size = [], 0

        def give():
            key, n = _merged(held)
            edges = np.searchsorted(key >> high, np.arange(shards + 1, dtype=np.uint64))
            return pd.DataFrame([(b, _zip_steps(key[a:z]), _zip(n[a:z])) for b, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if z > a], columns=["part", "keys", "n"])

        for frame in frames:
            text = frame["text"].tolist()
            for a, b in batches(text):
                key, n = np.unique(_tokens(text[a:b])[0], return_counts=True)
                held += [(key, n), (np.array([_BEGIN]), np.array([b - a]))]
                size += len(key)
                if size > _HELD:
                    held = [_merged(held)]
                    size = 0
                    if len(held[0][0]) > _HELD:
                        yield give()
                        held = []
        if held:
            yield give()

    def all_words(frames):
        for part, held in _by_part(frames, lambda keys, n: (_unzip_steps(keys, "<u8"), _unzip(n, "<u4")), "part", "keys", "n"):
            key, n = _merged(held)
            yield pd.DataFrame({"part": [part], "size": [len(key)], "keys": [_zip_steps(key)], "n": [_zip(n)]})

    by_word = texts.mapInPandas(words, "part int, keys binary, n binary").repartition(shards, "part").sortWithinPartitions("part")
    known = _put(by_word.mapInPandas(all_words, "part int, size long, keys binary, n binary"))
    n_words = spark.read.parquet(known).agg(F.sum("size")).first()[0] or 0

    def count(frames):
        lex = _words(known)
        begin = int(lex.find(np.array([_BEGIN]))[0])
        held, size = [], 0

        def give():
            u, v, w, c = _summed(held)
            shard = _shard(v, shards)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = [(b, *_zip_counts(*(x[order[a:z]] for x in (u, v, w, c)))) for b, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if z > a]
            return pd.DataFrame(rows, columns=["shard", "u", "v", "w", "c"])

        for frame in frames:
            text = frame["text"].tolist()
            for a, b in batches(text):
                w, _, first = _tokens(text[a:b])
                w = lex.find(w)
                v = _before(w, first, begin)
                held.append((_before(v, first, begin), v, w, np.ones(len(w), np.uint32)))
                size += len(w)
                if size > _HELD:
                    yield give()
                    held, size = [], 0
        if size:
            yield give()

    def add(frames):
        for shard, held in _by_part(frames, _unzip_counts, "shard", "u", "v", "w", "c"):
            u, v, w, c = _summed(held)
            head = _heads(v, w)
            n = np.diff(head, append=len(v))
            context, at = np.unique(_pair(u, v), return_inverse=True)
            sums = np.stack([np.bincount(at, x, len(context)) for x in (c, *(np.minimum(c, 3) == k for k in (1, 2, 3)))])
            often = [_most(sums[0], most_often, context, *sums)]
            of = np.unique(v, return_inverse=True)[1][head]
            bigram, trigram = _pair(v[head], w[head]), _pair(_pair(u, v), w)
            often.append(_most(np.add.reduceat(c, head), most_often, bigram, n, np.bincount(of, n)[of]))
            often.append(_most(c, most_often, trigram, c, sums[0][at]))
            maps = np.zeros((3, 1 << bits), bool)
            for k, x in enumerate((context, bigram, trigram)):
                maps[k][_bit(x, 0, bits)] = True
            own, at = np.unique(v[head], return_inverse=True)
            kinds = [np.bincount(at, np.minimum(n, 3) == k, len(own)) for k in (1, 2, 3)]
            ends, ended = np.unique(w[head], return_counts=True)
            many = lambda x: [int((x == k).sum()) for k in (1, 2, 3, 4)]
            packed = {"own": _zip_steps(own), "sums": _zip(np.stack([np.bincount(at, n, len(own)), *kinds]).astype("<u4").ravel()), "ends": _zip_steps(ends), "ended": _zip(ended.astype("<u4"))}
            packed |= {"often": [_zip_steps(x[0]) for x in often], "weights": [_zip(x[1].ravel()) for x in often], "bits": _zip(np.packbits(maps, axis=1).ravel())}
            yield pd.DataFrame({"shard": [shard]} | dict(zip("uvwc", ([x] for x in _zip_counts(u, v, w, c)), strict=True)) | {k: [x] for k, x in packed.items()} | {"many2": [many(n)], "many3": [many(c)]})

    kinds = "u binary, v binary, w binary, c binary"
    counted = texts.mapInPandas(count, f"shard int, {kinds}").repartition(shards, "shard").sortWithinPartitions("shard")
    counted = cut(counted.mapInPandas(add, f"shard int, {kinds}, own binary, sums binary, ends binary, ended binary, often array<binary>, weights array<binary>, bits binary, many2 array<long>, many3 array<long>"))

    def split(frames):
        """What shards know of a word, by the word's number."""
        for frame in frames:
            for own, sums, ends, ended in zip(frame["own"], frame["sums"], frame["ends"], frame["ended"], strict=True):
                own, sums, ends, ended = _unzip_steps(own, "<u4"), _unzip(sums, "<u4").reshape(4, -1), _unzip_steps(ends, "<u4"), _unzip(ended, "<u4")
                v, w = own % shards, ends % shards
                yield pd.DataFrame([(k, _zip_steps(own[v == k]), _zip(sums[:, v == k].ravel()), _zip_steps(ends[w == k]), _zip(ended[w == k])) for k in range(shards)], columns=["part", "own", "sums", "ends", "ended"])

    def together(frames):
        for part, held in _by_part(frames, lambda own, sums, ends, ended: (_unzip_steps(own, "<u4"), _unzip(sums, "<u4").reshape(4, -1), _unzip_steps(ends, "<u4"), _unzip(ended, "<u4")), "part", "own", "sums", "ends", "ended"):
            size = len(range(part, n_words + 1, shards))
            total, n = np.zeros((4, size), np.uint32), np.zeros(size, np.uint32)
            for own, sums, ends, ended in held:
                total[:, own // shards] += sums
                n[ends // shards] += ended
            d = n[n > 0]
            yield pd.DataFrame({"part": [part], "n": [_zip(n)], "sums": [_zip(total.ravel())], "seen": [len(d)], "total": [int(d.sum())], "many1": [[int((d == k).sum()) for k in (1, 2, 3, 4)]]})

    of = counted.select("own", "sums", "ends", "ended").mapInPandas(split, "part int, own binary, sums binary, ends binary, ended binary").repartition(shards, "part").sortWithinPartitions("part")
    sums = _put(of.mapInPandas(together, "part int, n binary, sums binary, seen long, total long, many1 array<long>"))
    totals = spark.read.parquet(sums).select("seen", "total", "many1").toPandas()
    parts = counted.select("shard", "often", "weights", "bits", "many2", "many3").toPandas()
    return Model(_lexicon(parts, totals, shards, known, sums, n_words), counted.select("shard", "u", "v", "w", "c"))


def _merged(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their numbers."""
    key, n = (np.concatenate(x) for x in zip(*held, strict=True))
    key, at = np.unique(key, return_inverse=True)
    return key, np.bincount(at, n, len(key)).astype("<u4")


def _by_part(frames, unpack, part: str, *columns: str):
    """Each part of rows that are sorted by it, with its unpacked rows."""
    held, now = [], None
    for frame in frames:
        for b, *packed in zip(frame[part].tolist(), *(frame[k] for k in columns), strict=True):
            if b != now and held:
                yield now, held
                held = []
            now = b
            held.append(unpack(*packed))
    if held:
        yield now, held
    release()


def _lexicon(parts: pd.DataFrame, totals: pd.DataFrame, shards: int, words: str, sums: str, n_words: int) -> Lexicon:
    """From a row of each shard: what is often met in it, bitmaps; and from totals of the words."""
    size = 1 << _own_bits(shards) - 3
    bits = np.zeros((3, shards * size), np.uint8)
    for shard, x in zip(parts["shard"], parts["bits"], strict=True):
        bits[:, shard * size : (shard + 1) * size] = _unzip(x, "u1").reshape(3, -1)
    many = lambda of, c: np.sum([[0] * 4, *of[c]], axis=0).tolist()
    many1, total, seen = many(totals, "many1"), int(totals["total"].sum()), int(totals["seen"].sum())
    d1, d2, d3 = _discounts(many1), _discounts(many(parts, "many2")), _discounts(many(parts, "many3"))
    off = d1[0] * many1[0] + d1[1] * many1[1] + d1[2] * (seen - many1[0] - many1[1])
    unknown = (off / total if total else 1.0) / (seen + 1)
    often = []
    for k, (rows, absent) in enumerate(((4, 1.0), (2, 0.0), (2, 0.0))):
        keys = np.concatenate([np.empty(0, "<u8"), *(_unzip_steps(x[k], "<u8") for x in parts["often"])])
        x = np.concatenate([np.empty((rows, 0), "<u4"), *(_unzip(x[k], "<u4").reshape(rows, -1) for x in parts["weights"])], axis=1)
        weights = np.array(d3) @ x[1:] / np.maximum(x[0], 1) if k == 0 else (x[0] - _off(x[0], (d2, d3)[k - 1])) / np.maximum(x[1], 1)
        order = np.argsort(keys)
        often.append(_Table(keys[order], weights[order], absent))
    return Lexicon(words, sums, n_words, d1, d2, d3, total, unknown, often, bits, shards)


def _most(of: np.ndarray, most: int, keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys, sorted, that are met most often, and their sums."""
    at = np.argsort(-of.astype(np.int64), kind="stable")[:most]
    at = at[np.argsort(keys[at])]
    return keys[at], np.stack([x[at] for x in sums]).astype("<u4")


def perplexity(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep (of simple types), n_tokens, log10 (of the probability) and perplexity of each row.

    A null text is empty, that is, its end. Rows that are equal in all of these columns and the
    text have equal results: their logarithms are summed up as whole numbers.
    """
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model.lexicon)
    shards = model.lexicon.shards
    bits = _own_bits(shards)
    salts = buckets_for(docs, text_col, 1, shards * _BUCKET_BYTES)
    names = [f"k{i}" for i in range(len(keep))]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = docs.select(*(F.col(c).cast("string").alias(n) for c, n in zip(keep, names, strict=True)), text, F.monotonically_increasing_id().alias("key"))

    def ask(frames):
        """Each row with the logarithms of all tokens that need no shard; the other tokens, packed by bucket."""
        lex = sent.value
        words, (p, g) = _words(lex.words), lex.weights
        begin = int(words.find(np.array([_BEGIN]))[0])
        held, size = [], 0

        def give():
            key, bucket, u, v, w = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(bucket, kind="stable")  # keys ascend
            key, bucket, u, v, w = (x[order] for x in (key, bucket, u, v, w))
            head = _heads(bucket)
            out = []
            for a, z in zip(head.tolist(), [*head[1:].tolist(), len(key)], strict=True):
                first = _heads(key[a:z])
                out.append((bucket[a], _zip_steps(key[a:z][first]), _zip(np.diff(first, append=z - a).astype("<u4")), b"".join(len(x).to_bytes(8, "little") + x for x in (_zip(u[a:z]), _zip(v[a:z]), _zip(w[a:z])))))
            return pd.DataFrame(out, columns=["bucket", "keys", "sizes", "grams"]).assign(key=-1, n_tokens=0, logs=0, **dict.fromkeys(names))

        for frame in frames:
            text, keys = frame.pop("text").tolist(), frame["key"].to_numpy()
            for a, b in batches(text, 1 << 20):
                w, length, first = _tokens(text[a:b])
                iw = words.find(w)
                iv = _before(iw, first, begin)
                iu = _before(iv, first, begin)
                shard = _shard(iv, shards)
                pair = _pair(iu, iv)
                may, found = [], []
                for k, x in enumerate((pair, _pair(iv, iw), _pair(pair, iw))):
                    hit = (iv > 0) & (iu > 0 if k == 0 else iw > 0 if k == 1 else may[0] & may[1])
                    hit[hit] = _held(lex.bitmaps[k], _bit(x[hit], shard[hit], bits))
                    at = np.zeros(len(w), np.int64)
                    at[hit] = lex.often[k].find(x[hit])
                    may.append(hit)
                    found.append(at)
                far = np.any([hit & (at == 0) for hit, at in zip(may, found, strict=True)], axis=0)
                o, two, three = (t.all[at] for t, at in zip(lex.often, found, strict=True))
                low = p[iw] * g[iv] + two
                # without a trigram, context and bigram are factors: a shard needn't know one that is known here
                own_u, own_w = (far & ~may[2] & ~(may[k] & (found[k] == 0)) for k in (0, 1))
                here = np.where(far, np.where(own_u, o, 1.0) * np.where(own_w, low / (p[0] * g[iv]), 1.0), low * o + three)
                logs = np.log10(np.maximum(here, 1e-300)) + np.where(iw > 0, 0.0, length * _LETTER)
                iu[own_u] = 0
                iw[own_w] = 0
                n, key = np.diff(first), keys[a:b]
                salt = (mix(key.astype(np.uint64)) % np.uint64(salts)).astype(np.int64)
                yield frame.iloc[a:b].assign(bucket=salt * shards + (key & (shards - 1)), n_tokens=n, logs=_units(np.add.reduceat(logs, first[:-1])), keys=None, sizes=None, grams=None)
                of = np.repeat(np.arange(b - a), n)[far]
                held.append((key[of], (shard[far] + salt[of] * shards).astype(np.int32), iu[far], iv[far] // np.uint32(shards), iw[far]))
                size += len(of)
                if size > _HELD:
                    yield give()
                    held, size = [], 0
        if size:
            yield give()
        release()

    sums = f"key long, n_tokens long, logs long{''.join(f', {n} string' for n in names)}"
    asked = rows.mapInPandas(ask, f"bucket int, keys binary, sizes binary, grams binary, {sums}")
    salted = model.shards.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = salted.select((F.col("salt") * shards + F.col("shard")).alias("bucket"), F.col("u").alias("keys"), F.col("v").alias("sizes"), F.col("w").alias("grams"), "c", *(F.lit(x).cast("long").alias(n) for n, x in (("key", -1), ("n_tokens", 0), ("logs", 0))))

    def answer(frames):
        lex = sent.value
        shard, now = None, None
        for frame in frames:
            own = frame["key"] >= 0
            if own.any():
                yield frame.loc[own, ["key", "n_tokens", "logs", *names]]
            rest = frame[~own]
            got = []
            for bucket, keys, sizes, grams, c in zip(rest["bucket"].tolist(), rest["keys"], rest["sizes"], rest["grams"], rest["c"], strict=True):
                if c is not None:
                    now, shard = bucket, None
                    shard = _Shard(lex, *_unzip_counts(keys, sizes, grams, c))
                elif bucket != now:
                    raise RuntimeError("tokens of a bucket without its shard")
                else:
                    head = np.concatenate([[0], np.cumsum(_unzip(sizes, "<u4"), dtype=np.int64)[:-1]])
                    parts, at = [], 0
                    for _ in range(3):
                        size = int.from_bytes(grams[at : at + 8], "little")
                        parts.append(_unzip(grams[at + 8 : at + 8 + size], "<u4"))
                        at += 8 + size
                    parts[1] = parts[1] * np.uint32(shards) + np.uint32(bucket % shards)
                    got.append((_unzip_steps(keys, "<i8"), _units(np.add.reduceat(shard.log10(*parts), head))))
            if got:
                key, logs = (np.concatenate(x) for x in zip(*got, strict=True))
                order = np.argsort(key, kind="stable")
                head = _heads(key[order])
                yield pd.DataFrame({"key": key[order][head], "n_tokens": 0, "logs": np.add.reduceat(logs[order], head)}).assign(**dict.fromkeys(names))
        release()

    # three buckets a task: their sums of a text are added up before they are sent
    both = asked.unionByName(salted, allowMissingColumns=True).repartitionById(tasks := -(-salts * shards // 3), F.col("bucket") % tasks).sortWithinPartitions("bucket", F.col("c").isNull())
    by_key = both.mapInPandas(answer, sums).groupBy("key").agg(F.sum("logs").alias("logs"), F.max("n_tokens").alias("n_tokens"), *(F.max(n).alias(n) for n in names))
    by_key = by_key.withColumn("log10", F.col("logs") / F.lit(_UNIT))
    own = [F.col(n).cast(docs.schema[c].dataType).alias(c) for c, n in zip(keep, names, strict=True)]
    return by_key.select(*own, "n_tokens", "log10", F.pow(F.lit(10.0), F.least(-F.col("log10") / F.greatest(F.col("n_tokens"), F.lit(1)), F.lit(300.0))).alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.99, most_rows: int | None = None, most_chars: int | None = None) -> DataFrame:
    """id, lang, n_tokens, perplexity, threshold and keep of each row.

    Trusted are labelled rows of quality 1 that aren't toxic: three in four of them (by a hash
    of the id) are to train on, the rest give each language's threshold. A language without such
    rows, and a null one, take the threshold over all; without any, all rows are kept.
    """
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col(id_col).alias("__id")).distinct()
    part = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit("threshold")), 4)
    model = train(docs, id_col, text_col, most_rows, most_chars, trusted.where(part("__id") != 3))
    scored = cut(perplexity(docs, model, [id_col, lang_col], text_col).drop("log10"))
    unseen = scored.where(part(id_col) == 3).join(trusted, F.col(id_col) == F.col("__id"), "left_semi")
    at = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)).alias("__at")
    own = unseen.where(F.col(lang_col).isNotNull()).groupBy(lang_col).agg(at).withColumnRenamed(lang_col, "__lang")
    whole = unseen.agg(at).first()[0]
    threshold = F.coalesce("__at", F.lit(whole).cast("double"))
    keep = threshold.isNull() | (F.col("perplexity") <= threshold)
    return scored.join(own, F.col(lang_col) == F.col("__lang"), "left").select(id_col, lang_col, "n_tokens", "perplexity", threshold.alias("threshold"), keep.alias("keep"))


def op5_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of all documents under a model of trusted ones, and which to keep."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
