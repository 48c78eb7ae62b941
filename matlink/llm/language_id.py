"""Language identification: script ranges, then Viterbi over words with a switching penalty.

Training counts, by language, hashed trigrams around each letter (inside words, with
word ends) and letters by script. For a text, each word's scripts narrow the languages
that can be its own; the rest get the sum of the word's trigram log probabilities. The
best path over the words, where a change of language costs a penalty, labels spans of
mixed-language text; the text's language is the one with most letters.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matlink.llm.common import batches, free_name, prepare

UNKNOWN = "und"
_BITS = 16
#: First code points of script ranges, and the script from there on. Fixed values (Unicode blocks).
_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0780, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x2C60, "Latin"), (0x2C80, "other"),
    (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x31A0, "Han"), (0x31F0, "Kana"), (0x3200, "Han"),
    (0xA000, "other"), (0xA720, "Latin"), (0xA800, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"),
    (0xFB50, "Arabic"), (0xFE00, "other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"),
    (0x10000, "other"), (0x20000, "Han"), (0x30000, "other"),
]
SCRIPTS = sorted({name for _, name in _RANGES})


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, its lower case, its script."""
    size = 0x110000
    letter = np.fromiter((chr(i).isalpha() for i in range(size)), bool, size)
    lower = np.arange(size, dtype=np.uint32)
    for i in map(int, np.flatnonzero(letter)):
        low = chr(i).lower()
        if len(low) == 1:
            lower[i] = ord(low)
    bounds = np.array([b for b, _ in _RANGES])
    script = np.array([SCRIPTS.index(name) for _, name in _RANGES], np.uint8)[np.searchsorted(bounds, np.arange(size), side="right") - 1]
    return letter, lower, script


class _Letters:
    """Letters of some texts, and the words (runs of letters) that they form."""

    def __init__(self, texts: list[str | None]):
        letter, lower, script = _tables()
        code = np.frombuffer("\n".join([*(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        inside = letter[code]
        self.at = np.flatnonzero(inside)
        low = np.where(inside, lower[code], np.uint32(0))
        around = np.concatenate([np.zeros(1, np.uint32), low, np.zeros(1, np.uint32)])
        with np.errstate(over="ignore"):
            h = around[self.at] * np.uint32(0x9E3779B1) + around[self.at + 1] * np.uint32(0x85EBCA77) + around[self.at + 2] * np.uint32(0xC2B2AE3D)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        self.gram = (h >> np.uint32(32 - _BITS)).astype(np.int64)
        self.script = script[code[self.at]]
        self.head = np.flatnonzero(np.diff(self.at, prepend=-2) > 1)  # first letter of each word
        self.start = self.at[self.head]
        self.size = np.diff(self.head, append=len(self.at))
        self.first = np.searchsorted(self.start, self.offsets)  # first word of each text


class Model:
    """languages; logs: trigram log probabilities (bucket by language); allowed: script by language; prior."""

    def __init__(self, languages: list[str], grams: np.ndarray, scripts: np.ndarray, texts: np.ndarray):
        self.languages = languages
        g = grams.T + 0.5
        self.logs = np.log(g / g.sum(axis=0)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        allowed = (share >= 1e-4).T
        allowed[~allowed.any(axis=1)] = True  # no language is known to use it
        self.allowed = allowed
        self.prior = np.log((texts + 1) / (texts.sum() + len(languages))).astype(np.float32)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from all texts with a language. Its size depends on the number of languages only.

    Rows with a null text or language are left out; with none left the model knows no language.
    """

    def count(frames):
        grams: dict = {}
        scripts: dict = {}
        texts: dict = {}
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                text = part["text"].tolist()
                texts[lang] = texts.get(lang, 0) + len(text)
                for a, b in batches(text):
                    x = _Letters(text[a:b])
                    grams[lang] = grams.get(lang, 0) + np.bincount(x.gram, minlength=1 << _BITS)
                    scripts[lang] = scripts.get(lang, 0) + np.bincount(x.script, minlength=len(SCRIPTS))
        if grams:
            yield pd.DataFrame({"lang": list(grams), "texts": [texts[k] for k in grams], "grams": [grams[k].astype("<i8").tobytes() for k in grams], "scripts": [scripts[k].astype("<i8").tobytes() for k in grams]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = {c: [np.sum([np.frombuffer(x, "<i8") for x in frame[c]], axis=0).tobytes()] for c in ("grams", "scripts")}
        return pd.DataFrame({"lang": frame["lang"][:1], "texts": [frame["texts"].sum()]} | total)

    prepare(docs.sparkSession)
    kind = "lang string, texts long, grams binary, scripts binary"
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    got = rows.mapInPandas(count, kind).groupBy("lang").applyInPandas(add, kind).toPandas().sort_values("lang")
    if not len(got):
        return Model([], np.zeros((0, 1 << _BITS)), np.zeros((0, len(SCRIPTS))), np.zeros(0))
    stack = lambda c: np.stack([np.frombuffer(x, "<i8") for x in got[c]])
    return Model(got["lang"].tolist(), stack("grams"), stack("scripts"), got["texts"].to_numpy())


def _step(state: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each lane's state before a word: the best language to come from, who stays, and the state at the word."""
    top = state.argmax(axis=1)
    jump = state[np.arange(len(state)), top][:, None] - penalty
    stay = state >= jump
    return top, stay, np.where(stay, state, jump)


def _paths(scores: np.ndarray, first: np.ndarray, prior: np.ndarray, penalty: float, segment: int = 256) -> np.ndarray:
    """The best language of each word by Viterbi.

    Texts are cut into segments, and all segments take a step at a time, so a step a word of a segment is enough for
    texts of any length. A segment's best scores from each language before it to each at its end (a matrix,
    max-plus) give the state at every border; with these, all segments run forward, and the language each comes
    from, given that at its end, joins them backward. The result is that of one run over each text.
    """
    scores, prior = scores.astype(np.float64), prior.astype(np.float64)
    counts, k = np.diff(first), scores.shape[1]
    path = np.zeros(len(scores), np.int16)
    pieces = -(-counts // segment)
    if not pieces.sum():
        return path
    index = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)  # a segment's place in its text
    begin = np.repeat(first[:-1], pieces) + index * segment
    size = np.minimum(np.repeat(first[1:], pieces) - begin, segment)
    last = index == np.repeat(pieces - 1, pieces)
    # states before each segment
    entry = np.zeros((len(begin), k))
    if not last.all():
        full = np.flatnonzero(~last)  # all of a whole segment's length
        best = np.where(np.eye(k, dtype=bool), 0.0, -penalty)[None] + scores[begin[full]][:, None, :]
        best[index[full] == 0] = (prior + scores[begin[full[index[full] == 0]]])[:, None, :]
        for t in range(1, segment):
            np.maximum(best, best.max(axis=2, keepdims=True) - penalty, out=best)
            best += scores[begin[full] + t][:, None, :]
        for i in range(int(index.max())):
            now = np.flatnonzero(index[full] == i)
            entry[full[now] + 1] = (entry[full[now]][:, :, None] + best[now]).max(axis=1)
    # all segments forward, the longest first
    order = np.argsort(-size, kind="stable")
    begin_, size_ = begin[order], size[order]
    active = np.searchsorted(-size_, -np.arange(int(size_[0]) + 1), side="left")  # segments of more than t words
    before, stays = np.zeros(len(scores), np.int16), np.zeros(scores.shape, bool)
    top, stay, state = _step(entry[order], penalty)
    before[begin_], stays[begin_] = top, stay
    state = np.where((index[order] == 0)[:, None], prior, state) + scores[begin_]
    end = np.zeros(len(begin), np.int64)  # the language at a segment's end, if it is its text's last
    for t in range(1, int(size_[0]) + 1):
        n = int(active[t])
        end[order[n : len(state)]] = state[n:].argmax(axis=1)
        if n:
            at = begin_[:n] + t
            before[at], stays[at], state = _step(state[:n], penalty)
            state = state + scores[at]
    # where each segment comes from, for every language at its end; then the ends, from the last segment back
    if not last.all():
        come = np.tile(np.arange(k), (len(begin), 1))
        for t in range(int(size_[0]) - 1, -1, -1):
            lanes = order[: int(active[t])]
            at, now = begin[lanes] + t, come[lanes]
            come[lanes] = np.where(np.take_along_axis(stays[at], now, axis=1), now, before[at][:, None])
        for i in range(int(index.max()), 0, -1):
            now = np.flatnonzero(index == i)
            end[now - 1] = come[now, end[now]]
    path[begin + size - 1] = end
    for t in range(int(size_[0]) - 1, 0, -1):
        at = begin_[: int(active[t])] + t
        now = path[at]
        path[at - 1] = np.where(stays[at, now], now, before[at])
    return path


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0, spans: bool = False) -> DataFrame:
    """All columns of docs, and lang_pred, score and, if asked for, lang_spans (start, end in code points, lang).

    score: the share of the text's letters on the path that are of its language, times the
    probability of that language for the whole text among all. A null text and one without
    letters are "und" with score 0 and no spans; so are all if the model knows no language.
    A column of docs with the name of a result is replaced.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = model.languages
    limit = max(1 << 16, (4 << 20) // max(len(names), 1))

    def label(texts: list) -> tuple[list, list, list]:
        m = sent.value
        x = _Letters(texts)
        langs, scores, marks = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        if not len(x.head) or not names:
            return langs, scores, marks
        word = np.add.reduceat(m.logs[x.gram], x.head, axis=0)
        used = np.zeros((len(x.head), len(SCRIPTS)), bool)
        used[np.repeat(np.arange(len(x.head)), x.size), x.script] = True
        possible = (used.astype(np.float32) @ m.allowed.astype(np.float32)) >= used.sum(axis=1, keepdims=True)
        possible[~possible.any(axis=1)] = True
        word = np.where(possible, word, word.min(axis=1, keepdims=True) - 50).astype(np.float32)
        path = _paths(word, x.first, m.prior, penalty)
        text = np.repeat(np.arange(len(texts)), np.diff(x.first))
        letters = np.zeros((len(texts), len(names)))
        np.add.at(letters, (text, path), x.size)
        filled = np.flatnonzero(np.diff(x.first))
        whole = np.zeros((len(texts), len(names)))
        whole[filled] = np.add.reduceat(word.astype(np.float64), x.first[filled], axis=0) + m.prior
        for i in filled.tolist():
            best = int(letters[i].argmax())
            belief = np.exp(whole[i] - whole[i].max())
            langs[i] = names[best]
            scores[i] = float(letters[i][best] / letters[i].sum() * belief[best] / belief.sum())
            if spans:
                a, b = int(x.first[i]), int(x.first[i + 1])
                cuts = np.concatenate([[a], np.flatnonzero(np.diff(path[a:b])) + a + 1, [b]])
                at = x.offsets[i]
                marks[i] = [{"start": int(x.start[p] - at), "end": int(x.start[q - 1] + x.size[q - 1] - at), "lang": names[int(path[p])]} for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return langs, scores, marks

    kind = "struct<lang_pred:string,score:double,lang_spans:array<struct<start:int,end:int,lang:string>>>"

    @F.pandas_udf(kind)
    def found(texts: pd.Series) -> pd.DataFrame:
        text = texts.tolist()
        parts = [label(text[a:b]) for a, b in batches(text, limit)]
        langs, scores, marks = ([v for p in parts for v in p[k]] for k in range(3))
        return pd.DataFrame({"lang_pred": langs, "score": scores, "lang_spans": marks})

    taken = {"lang_pred", "score", "lang_spans"}
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in taken]
    own = free_name(docs.columns, "__found")
    results = [f"{own}.lang_pred", f"{own}.score"] + [f"{own}.lang_spans"] * spans
    return docs.select(*rest, found(F.col(text_col).cast("string")).alias(own)).select(*rest, *results)


def _held_out(id_col: str, modulus: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == 2


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from three in four."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~_held_out("doc_id", 4)))
    found = identify(docs.select("doc_id", "text", F.coalesce(_held_out("doc_id", 4), F.lit(False)).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
