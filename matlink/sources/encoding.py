"""Which encoding files are in, told by all of their bytes, in tasks; and texts of any one-byte encoding.

UTF-16 is told by its mark, UTF-8 by being valid throughout. Other files are scored in each candidate: pairs of
neighbouring characters that words have (letters of one script, capitals first) count for it, and signs
inside words, capitals inside words, mixed scripts and letters that the encoding's languages hardly use against it.
"""

from __future__ import annotations

import codecs
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One-byte candidates, the likelier first, with the letters that their languages use often.
CANDIDATES = {
    "cp1252": "àâäáãåæçèéêëìíîïñòóôöõøùúûüßœÀÂÄÉÈÊÖÜÇÑÓÁÍÚ",
    "cp1250": "ąćęłńóśźżáčďéěíňřšťúůýžäôľöőüűăâîșțĄĆĘŁŃÓŚŹŻČŠŽŘÁÉÍÖŐÜ",
    "cp1251": "".join(map(chr, range(0x410, 0x450))) + "ёЁіїєІЇЄўґ",
    "koi8-r": "".join(map(chr, range(0x410, 0x450))) + "ёЁ",
    "cp1253": "".join(chr(c) for c in range(0x386, 0x3CF) if unicodedata.category(chr(c))[0] == "L"),
}
FALLBACK = "latin-1"
_HEAD = 20_000


@cache
def characters(encoding: str) -> list[str | None]:
    """The character of each byte, None where a byte has none."""
    out: list[str | None] = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(None)
    return out


def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


@cache
def pair_scores(encoding: str) -> np.ndarray:
    """What each pair of neighbouring bytes says for an encoding; pairs of plain bytes say nothing."""
    chars, common = characters(encoding), set(CANDIDATES[encoding])
    kind = ["undefined" if c is None or 0x80 <= ord(c) < 0xA0 else "upper" if c.isupper() else "lower" if c.isalpha() else "other" for c in chars]
    script = [_script(c) if k in ("upper", "lower") else "" for c, k in zip(chars, kind, strict=True)]
    out = np.zeros((256, 256), np.int64)
    for a in range(256):
        for b in range(256):
            if a < 0x80 and b < 0x80:
                continue
            score = -6 * (kind[a] == "undefined") - 6 * (kind[b] == "undefined")
            letters = script[a], script[b]
            if all(letters):
                score += 2 if letters[0] == letters[1] else -6
                score -= 6 * (kind[a] == "lower" and kind[b] == "upper") + (kind[a] == kind[b] == "upper")
            elif any(letters) and "other" in (kind[a], kind[b]) and (a if kind[a] == "other" else b) >= 0x80:
                score -= 3  # a sign inside a word
            score += sum(1 if chars[x] in common else -1 for x in (a, b) if x >= 0x80 and script[x])
            out[a, b] = score
    return out.ravel()


def detect(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding, head, open_quotes) of every file under path: a Python codec's name, its first bytes (20,000 at
    most), and does any line hold an odd number of quotes.

    A file without bytes has no row.
    """
    names = list(CANDIDATES)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("line"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            at = batch["at"].to_numpy()
            files = batch["file"].dictionary_encode()
            of = files.indices.to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1])])) if len(at) else []
            for a, z in zip(first, [*first[1:], len(at)], strict=True):
                file, lines = files.dictionary[int(of[a])].as_py(), batch["line"].cast(pa.binary()).slice(a, z - a)
                ends = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
                data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
                ends = ends[1:] - ends[0]
                held = lambda which: np.searchsorted(ends, np.flatnonzero(which), side="right")  # noqa: B023, E731  the lines of some bytes
                head = None
                if at[a] == 0 and file not in seen:
                    n = int(np.searchsorted(ends, _HEAD)) + 1  # of lines that begin among the first bytes
                    head = b"\n".join(lines.slice(0, n).to_pylist())[:_HEAD]
                    seen.add(file)
                odd = lines.take(pa.array(np.unique(held(data >= 0x80)))).to_pylist()
                valid = True
                for x in odd:
                    try:
                        x.decode("utf-8")
                    except UnicodeDecodeError:
                        valid = False
                        break
                every = np.frombuffer(b"\n".join(odd), np.uint8).astype(np.int64)
                pairs = np.bincount(every[:-1] * 256 + every[1:], minlength=1 << 16) if len(every) > 1 else None
                scores = [0 if pairs is None else int((pairs * pair_scores(n)).sum()) for n in names]
                bare = bool(np.isin(every, [b for b, c in enumerate(characters("cp1252")) if c is None]).any())
                wide = any(x.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)) for x in odd)
                quotes = bool((np.bincount(held(data == 0x22)) % 2).any())
                found = {"file": [file], "head": [head], "valid": [valid], "wide": [wide and bool((data == 0).any())], "bare": [bare], "quotes": [quotes], "scores": [scores]}
                yield pa.RecordBatch.from_pydict(found, pa.schema([("file", pa.string()), ("head", pa.binary()), ("valid", pa.bool_()), ("wide", pa.bool_()), ("bare", pa.bool_()), ("quotes", pa.bool_()), ("scores", pa.list_(pa.int64()))]))

    parts = lines.mapInArrow(score, "file string, head binary, valid boolean, wide boolean, bare boolean, quotes boolean, scores array<long>")
    sums = [F.sum(F.col("scores")[i]).alias(n) for i, n in enumerate(names)]
    files = parts.groupBy("file").agg(F.first("head", ignorenulls=True).alias("head"), F.bool_and("valid").alias("valid"), F.bool_or("wide").alias("wide"), F.bool_or("bare").alias("bare"), F.bool_or("quotes").alias("open_quotes"), *sums)
    best = F.greatest(*(F.col(f"`{n}`") for n in names))
    guess = F.coalesce(*(F.when(F.col(f"`{n}`") == best, F.lit(n)) for n in names))
    told = F.when(F.col("wide"), "utf-16").when(F.col("valid"), "utf-8").when((guess == "cp1252") & F.col("bare"), FALLBACK).otherwise(guess)
    return files.select("file", told.alias("encoding"), "head", "open_quotes")


def _differing(encoding: str) -> tuple[str, str]:
    """Characters of latin-1 and what the encoding has in their place."""
    pairs = [(chr(b), c) for b, c in enumerate(characters(encoding)) if c is not None and c != chr(b)]
    return "".join(a for a, _ in pairs), "".join(c for _, c in pairs)


def decoded(text: Column, encoding: str) -> Column:
    """A text read as latin-1 whose bytes are in a one-byte encoding."""
    before, after = _differing(encoding)
    return F.translate(text, before, after) if before else text


def encoded(text: Column, encoding: str) -> Column:
    """The reverse: a text that gives the encoding's bytes where it is written as latin-1."""
    before, after = _differing(encoding)
    return F.translate(text, after, before) if before else text


def fits(text: Column, encoding: str) -> Column:
    """Has the encoding a byte for every character of a text."""
    return F.translate(text, "".join(c for c in characters(encoding) if c is not None), "") == ""
