"""Language-model scores of texts by a hidden Markov model trained with Baum-Welch.

Tokens are words, and an end after the last. The words with at least a fixed share of all
training tokens (so their number is bounded) are symbols of their own; all other words fall
into classes by their last letters, and a class is a symbol. The states emit symbols, and a
class emits its words by absolute discounting: (c - D) / N of the class for a word of count
c, and D V / N for the event that a word is unknown. So the probabilities of the known words
and the unknown sum to one.

1. Words are counted in shards by hash; a task sums up its own before it sends them.
2. All texts are encoded to symbols once, and kept. Each Baum-Welch round runs over the
   symbols of all training texts, in segments; expected counts are summed up per task,
   then across tasks, in pieces of fixed size.
3. A text's score is the exact likelihood of its symbols by the scaled forward recursion
   over the whole text, times the class probabilities of its rare words. These come from a
   join of the rare words with the count shards, summed up by text on the way back.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matlink.llm.common import batches, buckets_for, cut, prepare
from matlink.llm.wordvec import Words, mix

_CLASS_BITS = 12
_CLASSES = 1 << _CLASS_BITS
_LOW = np.uint64(_CLASSES - 1)
_PART = 1 << 15
_HELD = 1_500_000
#: Bytes of training text whose words a bucket counts; more text makes more buckets.
_BUCKET_BYTES = 128 << 20
_SKETCH = 64
_SEGMENT = 128
_LONG = 2048


def _keys(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of all texts: 52 bits of its hash with its class below; index of each text's first word."""
    w = Words(texts, lower=True)
    if not len(w.hashes):
        return w.hashes, w.first
    last = np.zeros(len(w.hashes), np.uint64)
    for back in (1, 2, 3):
        at = w.ends - back
        byte = np.where(at >= w.starts, w.data[np.maximum(at, 0)], 0).astype(np.uint64)
        last = last * np.uint64(257) + byte
    return (w.hashes & ~_LOW) | (mix(last) & _LOW), w.first


@dataclass
class Counts:
    """Counts of training words: shards (bucket, keys, counts), all tokens and types with the end, and texts."""

    shards: DataFrame
    buckets: int
    tokens: int
    types: int
    texts: int


def count_words(docs: DataFrame, text_col: str = "text") -> Counts:
    """Counts of the words of all texts, in shards by hash. A null text has no words."""
    spark = docs.sparkSession
    prepare(spark)
    buckets = buckets_for(docs, text_col, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), _BUCKET_BYTES)

    def count(frames):
        held, size, texts = [], 0, 0

        def give():
            key, n = _summed(held)
            bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(b, 0, key[order[a:z]].astype("<u8").tobytes(), n[order[a:z]].astype("<i8").tobytes()) for b, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if z > a]
            return pd.DataFrame(rows, columns=["bucket", "texts", "keys", "counts"])

        for frame in frames:
            text = frame["text"].tolist()
            texts += len(text)
            for a, b in batches(text):
                key, n = np.unique(_keys(text[a:b])[0], return_counts=True)
                held.append((key, n))
                size += len(key)
                if size > _HELD:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if size > _HELD // 2:
                        yield give()
                        held, size = [], 0
        if size:
            yield give()
        yield pd.DataFrame({"bucket": [0], "texts": [texts], "keys": [b""], "counts": [b""]})

    def add(frames):
        held, now, texts = [], None, 0

        def give():
            key, n = _summed(held)
            return pd.DataFrame({"bucket": [now], "texts": [texts], "types": [len(key)], "tokens": [int(n.sum())], "keys": [key.astype("<u8").tobytes()], "counts": [n.astype("<i8").tobytes()]})

        for frame in frames:
            for b, t, k, n in zip(frame["bucket"].tolist(), frame["texts"].tolist(), frame["keys"], frame["counts"], strict=True):
                if b != now and now is not None:
                    yield give()
                    held, texts = [], 0
                now, texts = b, texts + t
                held.append((np.frombuffer(k, "<u8"), np.frombuffer(n, "<i8")))
        if now is not None:
            yield give()

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(count, "bucket int, texts long, keys binary, counts binary")
    shards = cut(rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInPandas(add, "bucket int, texts long, types long, tokens long, keys binary, counts binary"))
    types, tokens, texts = shards.agg(F.sum("types"), F.sum("tokens"), F.sum("texts")).first()
    texts = texts or 0
    return Counts(shards, buckets, (tokens or 0) + texts, (types or 0) + (1 if texts else 0), texts)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and the sums of their counts."""
    if not held:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    key, n = (np.concatenate(x) for x in zip(*held, strict=True))
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[head], np.add.reduceat(n, head)


@dataclass
class Model:
    """frequent: sorted keys; symbols: those, the classes, the end. Probabilities by state; class statistics."""

    frequent: np.ndarray
    counts: np.ndarray
    class_tokens: np.ndarray
    class_types: np.ndarray
    discount: float
    start: np.ndarray
    begin: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @property
    def end(self) -> int:
        return len(self.frequent) + _CLASSES

    def symbols(self, key: np.ndarray) -> np.ndarray:
        out = (key & _LOW).astype(np.int64) + len(self.frequent)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, key), len(self.frequent) - 1)
            out = np.where(self.frequent[at] == key, at, out)
        return out


def _with_ends(symbols: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with an end after each text; where the texts begin now."""
    return np.insert(symbols, first[1:], end), first + np.arange(len(first))


def _vocabulary(counts: Counts, share: float):
    """The frequent words and their counts, at most 1 / share; statistics of the classes of all others."""
    least = max(share * counts.tokens, 1)

    def part(frames):
        tokens, types, ones, twos = np.zeros(_CLASSES, np.int64), np.zeros(_CLASSES, np.int64), 0, 0
        top_keys, top_counts = [], []
        for frame in frames:
            for k, n in zip(frame["keys"], frame["counts"], strict=True):
                key, n = np.frombuffer(k, "<u8"), np.frombuffer(n, "<i8")
                often = n >= least
                top_keys.append(key[often])
                top_counts.append(n[often])
                of = (key[~often] & _LOW).astype(np.int64)
                tokens += np.bincount(of, n[~often], _CLASSES).astype(np.int64)
                types += np.bincount(of, minlength=_CLASSES)
                ones, twos = ones + int((n[~often] == 1).sum()), twos + int((n[~often] == 2).sum())
        key = np.concatenate(top_keys) if top_keys else np.empty(0, np.uint64)
        n = np.concatenate(top_counts) if top_counts else np.empty(0, np.int64)
        yield pd.DataFrame({"tokens": [tokens.astype("<i8").tobytes()], "types": [types.astype("<i8").tobytes()], "ones": [ones], "twos": [twos], "keys": [key.astype("<u8").tobytes()], "counts": [n.astype("<i8").tobytes()]})

    kind = "tokens binary, types binary, ones long, twos long, keys binary, counts binary"
    # one row of fixed size a group of shards, and the frequent words once
    got = counts.shards.select("keys", "counts").coalesce(32).mapInPandas(part, kind).toPandas()
    key = np.concatenate([np.frombuffer(x, "<u8") for x in got["keys"]]) if len(got) else np.empty(0, np.uint64)
    n = np.concatenate([np.frombuffer(x, "<i8") for x in got["counts"]]) if len(got) else np.empty(0, np.int64)
    order = np.argsort(key)
    total = lambda c: np.sum([np.frombuffer(x, "<i8") for x in got[c]], axis=0) if len(got) else np.zeros(_CLASSES, np.int64)
    ones, twos = int(got["ones"].sum()), int(got["twos"].sum())
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    return key[order], n[order], total("tokens"), total("types"), discount


def untrained(counts: Counts, states: int = 8, share: float = 5e-5, smoothing: float = 0.05) -> Model:
    """The symbols of the words of counts, and a model that knows no more than how often they occur."""
    frequent, n, tokens, types, discount = _vocabulary(counts, share)
    unigram = np.concatenate([n, tokens, [counts.texts]]).astype(float) + smoothing
    unigram /= unigram.sum()
    ones = np.full(states, 1 / states)
    stay = 0.9
    move = np.full((states, states), (1 - stay) / (states - 1)) + np.eye(states) * (stay - (1 - stay) / (states - 1)) if states > 1 else np.ones((1, 1))
    return Model(frequent, n, tokens, types, discount, ones, ones, move, np.repeat(unigram[:, None], states, axis=1))


def encode(docs: DataFrame, model: Model, counts: Counts, id_col: str = "doc_id", text_col: str = "text", learned: Column | None = None) -> DataFrame:
    """All texts as symbols, so that no later pass reads the texts; kept in the checkpoint folder.

    Rows of bucket -1 are the rows of docs: a number of their own, id, learned, n_tokens, n_known
    and base of the frequent words, and their symbols. The other rows are rare words by bucket.
    """
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)
    buckets, trained = counts.buckets, counts.texts
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (F.lit(True) if learned is None else learned).alias("learned"))

    def local(frames):
        m = sent.value
        kind = _kind(m)
        next_row = TaskContext.get().partitionId() << 40
        held_rows, held_keys, size = [], [], 0

        def give():
            row, key = np.concatenate(held_rows), np.concatenate(held_keys)
            bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((row, bucket))
            row, key = row[order], key[order]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                if z > a:
                    head = np.concatenate([[0], np.flatnonzero(np.diff(row[a:z])) + 1])
                    n = np.diff(head, append=z - a)
                    rows.append((b, row[a:z][head].astype("<i8").tobytes(), n.astype("<i4").tobytes(), key[a:z].astype("<u8").tobytes()))
            return pd.DataFrame(rows, columns=["bucket", "rows", "sizes", "keys"]).assign(id=pd.array([pd.NA] * len(rows), "Int64"), learned=False, n_tokens=0, n_known=0, base=0.0, symbols=None)

        for frame in frames:
            ids, text, learn = frame["id"].astype("Int64"), frame["text"].tolist(), frame["learned"].to_numpy()
            row = next_row + np.arange(len(text), dtype=np.int64)
            next_row += len(text)
            for a, b in batches(text, 4 << 20):
                key, first = _keys(text[a:b])
                sym = m.symbols(key)
                common = sym < len(m.frequent)
                owner = np.repeat(np.arange(b - a), np.diff(first))
                base = np.bincount(owner[common], np.log10(m.counts[sym[common]] + 1), b - a) + np.log10(trained + 1)
                known = np.bincount(owner[common], minlength=b - a) + (trained > 0)
                packed = sym.astype(kind)
                out = pd.DataFrame({"bucket": -1, "sizes": None, "keys": None, "id": ids.iloc[a:b].array, "learned": learn[a:b], "n_tokens": np.diff(first) + 1, "n_known": known, "base": base})
                yield out.assign(rows=[x.tobytes() for x in row[a:b].astype("<i8")], symbols=[packed[x:y].tobytes() for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
                held_rows.append(row[a:b][owner[~common]])
                held_keys.append(key[~common])
                size += len(held_keys[-1])
                if size > _HELD:
                    yield give()
                    held_rows, held_keys, size = [], [], 0
        if size:
            yield give()

    out = cut(texts.mapInPandas(local, "bucket int, rows binary, sizes binary, keys binary, id long, learned boolean, n_tokens long, n_known long, base double, symbols binary"))
    sent.unpersist()
    return out


def _kind(m: Model) -> str:
    return "<u2" if m.end < 1 << 16 else "<u4"


def _chunks(packed: Iterable[bytes], m: Model, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of texts, symbols and bounds of runs of texts of about most symbols, or of one text."""
    kind = _kind(m)
    size, held, n = np.dtype(kind).itemsize, [], 0
    for x in [*packed, None]:
        if held and (x is None or n + len(x) // size > most):
            first = np.concatenate([[0], np.cumsum([len(h) // size for h in held])])
            yield len(held), np.frombuffer(b"".join(held), kind).astype(np.int64), first
            held, n = [], 0
        if x is not None:
            held.append(x)
            n += len(x) // size


def train(docs: DataFrame, counts: Counts, text_col: str = "text", states: int = 8, rounds: int = 5, share: float = 5e-5, smoothing: float = 0.05) -> Model:
    """A model of all texts of docs, whose words are counts."""
    model = untrained(counts, states, share, smoothing)
    numbered = docs.select(F.lit(None).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    return fit(encode(numbered, model, counts, "__id", "__text"), model, counts, rounds, smoothing)


def fit(coded: DataFrame, model: Model, counts: Counts, rounds: int = 5, smoothing: float = 0.05) -> Model:
    """model after rounds of Baum-Welch over the learned rows of encode().

    The first emissions come from all texts, too, of any length and in any order: texts are
    parted by the main directions in which their symbols differ, and each part's counts are
    half of a state's emissions. A fixed perturbation tells the states apart where texts don't.
    """
    texts = coded.where("bucket < 0 and learned").select("symbols")
    unigram, states = model.emit[:, 0].copy(), model.emit.shape[1]
    if counts.texts and states > 1:
        model.emit = _first_emissions(texts, model, unigram, states)
    size = len(unigram) * states + states * states + 2 * states
    for _ in range(rounds if counts.texts else 0):
        total = _totals(texts, model, size, _expected)
        emit, rest = total[: len(unigram) * states].reshape(-1, states), total[len(unigram) * states :]
        move, start, begin = rest[: states * states].reshape(states, states), rest[states * states : -states], rest[-states:]
        emit = emit + smoothing * unigram[:, None] * len(unigram) / 100
        model.emit, model.move = emit / emit.sum(axis=0), (move + 0.1) / (move + 0.1).sum(axis=1, keepdims=True)
        model.start, model.begin = (start + 0.1) / (start + 0.1).sum(), (begin + 0.1) / (begin + 0.1).sum()
    return model


def _totals(texts: DataFrame, model: Model, size: int, fill) -> np.ndarray:
    """The sums that fill(model, symbols, first, total) adds to over all texts: per task, then across tasks in pieces."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def each(frames):
        total = np.zeros(size)
        for frame in frames:
            for _, sym, first in _chunks(frame["symbols"].tolist(), sent.value, 1 << 18):
                fill(sent.value, sym, first, total)
        for part in range(0, size, _PART):
            yield pd.DataFrame({"part": [part], "sums": [total[part : part + _PART].astype("<f8").tobytes()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": frame["part"][:1], "sums": [np.sum([np.frombuffer(x, "<f8") for x in frame["sums"]], axis=0).tobytes()]})

    got = texts.mapInPandas(each, "part int, sums binary").groupBy("part").applyInPandas(add, "part int, sums binary").toPandas().sort_values("part")
    sent.unpersist()
    return np.concatenate([np.frombuffer(x, "<f8") for x in got["sums"]])


def _first_emissions(texts: DataFrame, model: Model, unigram: np.ndarray, states: int) -> np.ndarray:
    """First emissions of the states, from two passes over all texts."""
    code = mix(np.arange(len(unigram), dtype=np.uint64))
    place, sign = (code % np.uint64(_SKETCH)).astype(np.int64), np.where(code >> np.uint64(63), 1.0, -1.0)
    weight = sign * np.minimum(np.sqrt(1e-4 / unigram), 1)  # frequent words say little of a text

    def sketch(sym, first):
        n = len(first) - 1
        owner = np.repeat(np.arange(n), np.diff(first))
        rows = np.bincount(owner * _SKETCH + place[sym], weight[sym], n * _SKETCH).reshape(n, _SKETCH)
        return owner, rows / np.maximum(np.sqrt((rows**2).sum(axis=1, keepdims=True)), 1e-12)

    def spread(m, sym, first, total):
        rows = sketch(sym, first)[1]
        total += np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows).ravel()])

    total = _totals(texts, model, 1 + _SKETCH + _SKETCH * _SKETCH, spread)
    mean = total[1 : 1 + _SKETCH] / total[0]
    ways = np.linalg.eigh(total[1 + _SKETCH :].reshape(_SKETCH, _SKETCH) / total[0] - np.outer(mean, mean))[1][:, ::-1]
    ways = ways[:, : min((states - 1).bit_length(), _SKETCH)]
    ways = ways * np.sign(ways[np.abs(ways).argmax(axis=0), np.arange(ways.shape[1])])

    def count(m, sym, first, total):
        owner, rows = sketch(sym, first)
        part = ((rows - mean) @ ways > 0) @ (1 << np.arange(ways.shape[1])) % states
        total += np.bincount(sym * states + part[owner], minlength=len(total))

    own = _totals(texts, model, len(unigram) * states, count).reshape(-1, states)
    own = own + unigram[:, None]
    noise = mix(np.arange(own.size, dtype=np.uint64) + np.uint64(1 << 32)).astype(float).reshape(own.shape) / 2.0**64
    out = (0.5 * unigram[:, None] + 0.5 * own / own.sum(axis=0)) * (0.9 + 0.2 * noise)
    return out / out.sum(axis=0)


@dataclass
class _Lanes:
    """Runs of symbols side by side, longest first, step by step: where each symbol stands, and each step's bounds."""

    here: np.ndarray
    bounds: list[int]
    order: np.ndarray

    @classmethod
    def of(cls, begin: np.ndarray, length: np.ndarray):
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        steps = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(steps), side="left")
        off = np.concatenate([[0], np.cumsum(active)])
        lane = np.arange(off[-1]) - np.repeat(off[:-1], active)
        return cls(begin[lane] + np.repeat(np.arange(steps), active), off.tolist(), order)


def _forward_steps(m: Model, emit: np.ndarray, bounds: list[int], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities (states by symbols) and the scales; first: of each lane's first state."""
    alpha, scale, move = np.empty_like(emit), np.empty(emit.shape[1]), np.ascontiguousarray(m.move.T)
    for t in range(len(bounds) - 1):
        lo, hi = bounds[t], bounds[t + 1]
        before = first if t == 0 else move @ alpha[:, bounds[t - 1] : bounds[t - 1] + hi - lo]
        a = np.multiply(before, emit[:, lo:hi], out=alpha[:, lo:hi])
        c = np.sum(a, axis=0, out=scale[lo:hi])
        a /= c
    return alpha, scale


def _expected(m: Model, sym: np.ndarray, first: np.ndarray, total: np.ndarray) -> None:
    """Adds the expected counts of some texts: forward and backward over segments, all at a time."""
    states, size = m.emit.shape[1], len(m.emit)
    sym, at = _with_ends(sym, first, m.end)
    pieces = -(-np.diff(at) // _SEGMENT)
    begin = np.repeat(at[:-1], pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * _SEGMENT
    length = np.minimum(np.repeat(at[1:], pieces) - begin, _SEGMENT)
    lanes = _Lanes.of(begin, length)
    head = np.isin(begin, at[:-1])[lanes.order]
    sym, bounds = sym[lanes.here], lanes.bounds
    emit = np.stack([e[sym] for e in np.ascontiguousarray(m.emit.T)])
    alpha, scale = _forward_steps(m, emit, bounds, np.where(head, m.start[:, None], m.begin[:, None]))
    emit /= scale
    moves, beta = np.zeros((states, states)), np.ones((states, len(begin)))
    for t in range(len(bounds) - 2, -1, -1):
        lo, hi = bounds[t], bounds[t + 1]
        if t + 2 < len(bounds):
            after = bounds[t + 2] - hi
            e = emit[:, hi : hi + after] * beta[:, :after]
            moves += alpha[:, lo : lo + after] @ e.T
            beta[:, :after] = m.move @ e
        alpha[:, lo:hi] *= beta[:, : hi - lo]  # gamma from now on
    for s in range(states):
        total[s : size * states : states] += np.bincount(sym, alpha[s], size)
    rest, start = total[size * states :], alpha[:, : len(begin)]
    rest[: states * states] += (moves * m.move).reshape(-1)
    rest[states * states : -states] += start[:, head].sum(axis=1)
    rest[-states:] += start[:, ~head].sum(axis=1)


def _forward(m: Model, sym: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 likelihood of the symbols of each text, by the scaled forward recursion over all of it."""
    lanes = _Lanes.of(at[:-1], np.diff(at))
    sym = sym[lanes.here]
    emit = np.stack([e[sym] for e in np.ascontiguousarray(m.emit.T)])
    logs = np.log10(_forward_steps(m, emit, lanes.bounds, m.start[:, None])[1])
    back = np.empty(len(at) - 1)
    lane = np.arange(len(sym)) - np.repeat(lanes.bounds[:-1], np.diff(lanes.bounds))
    back[lanes.order] = np.bincount(lane, logs, len(back))
    return back


def score(docs: DataFrame, model: Model, counts: Counts, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score of each row.

    base_score adds one to all counts, over the known words and one unknown. A null or empty
    text is its end. Rows are numbered as they are written to the checkpoint, so repeated rows
    and null ids are rows of their own. With no training text every word is unknown.
    """
    return score_coded(encode(docs, model, counts, id_col, text_col), model, counts, id_col).drop("learned")


def score_coded(coded: DataFrame, model: Model, counts: Counts, id_col: str = "doc_id") -> DataFrame:
    """score() of the rows of encode(), and their learned."""
    sent = coded.sparkSession.sparkContext.broadcast(model)
    buckets, log_all = counts.buckets, float(np.log10(counts.tokens + counts.types + 1))

    def forward(frames):
        m = sent.value
        size = np.dtype(_kind(m)).itemsize
        long, n = [], 0

        def done(frame: pd.DataFrame) -> pd.DataFrame:
            got = [_forward(m, *_with_ends(sym, first, m.end)) for _, sym, first in _chunks(frame.pop("symbols").tolist(), m, 1 << 20)]
            return frame.assign(hmm=np.concatenate(got) if got else np.zeros(0), id=frame["id"].astype("Int64"))

        for frame in frames:
            sizes = frame["symbols"].str.len() // size
            beyond = sizes > _LONG  # held, so that many of these go side by side
            yield done(frame[~beyond].copy())
            if beyond.any():
                long.append(frame[beyond])
                n += int(sizes[beyond].sum())
            if n > 1 << 20:
                yield done(pd.concat(long))
                long, n = [], 0
        if long:
            yield done(pd.concat(long))

    own = coded.where("bucket < 0").select("rows", "id", "learned", "n_tokens", "n_known", "base", "symbols")
    own = own.mapInPandas(forward, "rows binary, id long, learned boolean, n_tokens long, n_known long, base double, hmm double")
    asked = coded.where("bucket >= 0").select("bucket", "rows", "sizes", "keys", F.lit(None).cast("binary").alias("counts"))
    shards = counts.shards.select("bucket", F.lit(None).cast("binary").alias("rows"), F.lit(None).cast("binary").alias("sizes"), "keys", "counts")

    def answer(frames):
        m = sent.value
        known, known_n, waiting, now = np.empty(0, np.uint64), np.empty(0, np.int64), [], None
        sums: list[tuple] = []

        def judge():
            for rows, sizes, keys in waiting:
                row, n, key = np.frombuffer(rows, "<i8"), np.frombuffer(sizes, "<i4"), np.frombuffer(keys, "<u8")
                at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
                c = np.where(known[at] == key, known_n[at], 0) if len(known) else np.zeros(len(key), np.int64)
                of = (key & _LOW).astype(np.int64)
                tokens, types = m.class_tokens[of], m.class_types[of]
                seen = np.log10(np.maximum(c - m.discount, 1e-9)) - np.log10(np.maximum(tokens, 1))
                unseen = np.where(tokens > 0, np.log10(np.maximum(m.discount * types, 1e-9)) - np.log10(np.maximum(tokens, 1)), 0)
                head = np.concatenate([[0], np.cumsum(n)[:-1]])
                sums.append((row, np.add.reduceat((c > 0).astype(np.int64), head), np.add.reduceat(np.log10(c + 1), head), np.add.reduceat(np.where(c > 0, seen, unseen), head)))

        def give():
            row, known_, base, inside = (np.concatenate(x) for x in zip(*sums, strict=True))
            order = np.argsort(row, kind="stable")
            row = row[order]
            head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            total = [np.add.reduceat(x[order], head) for x in (known_, base, inside)]
            row = row[head]
            to = (mix(row.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[order], np.arange(buckets + 1))
            return pd.DataFrame(
                [(b, row[order[a:z]].astype("<i8").tobytes(), *(x[order[a:z]].astype(t).tobytes() for x, t in zip(total, ("<i4", "<f8", "<f8"), strict=True))) for b, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if z > a],
                columns=["bucket", "rows", "known", "base", "inside"],
            )

        for frame in frames:
            for b, rows, sizes, keys, n in zip(frame["bucket"].tolist(), frame["rows"], frame["sizes"], frame["keys"], frame["counts"], strict=True):
                if b != now:
                    judge()
                    known, known_n, waiting, now = np.empty(0, np.uint64), np.empty(0, np.int64), [], b
                if n is not None:
                    known, known_n = np.frombuffer(keys, "<u8"), np.frombuffer(n, "<i8")
                else:
                    waiting.append((rows, sizes, keys))
        judge()
        if sums:
            yield give()

    def gather(frames):
        held, now = [], None

        def give():
            row, known, base, inside = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(row, kind="stable")
            row = row[order]
            head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            return pd.DataFrame({"rows": [x.tobytes() for x in row[head].astype("<i8")], "known": np.add.reduceat(known[order].astype(np.int64), head), "rare_base": np.add.reduceat(base[order], head), "inside": np.add.reduceat(inside[order], head)})

        for frame in frames:
            for b, *packed in zip(frame["bucket"].tolist(), frame["rows"], frame["known"], frame["base"], frame["inside"], strict=True):
                if b != now and held:
                    yield give()
                    held = []
                now = b
                held.append(tuple(np.frombuffer(p, t) for p, t in zip(packed, ("<i8", "<i4", "<f8", "<f8"), strict=True)))
        if held:
            yield give()

    answers = asked.unionByName(shards).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInPandas(answer, "bucket int, rows binary, known binary, base binary, inside binary")
    rare = answers.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInPandas(gather, "rows binary, known long, rare_base double, inside double")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return own.join(rare, "rows", "left").select(
        F.col("id").alias(id_col),
        "learned",
        "n_tokens",
        (F.col("n_known") + zero("known")).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base") - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("hmm") + zero("inside")).alias("score"),
    )


def op6_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model of six in seven of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    counts = count_words(docs.where(~held_out))
    model = untrained(counts)
    coded = encode(docs, model, counts, learned=~held_out)
    scored = score_coded(coded, fit(coded, model, counts), counts)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
