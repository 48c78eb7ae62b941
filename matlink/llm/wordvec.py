"""Vectorised words of a batch of texts: bounds, 64-bit hashes, n-gram hashes.

Whole Arrow batches are handled with numpy: the texts are joined into one byte
array, a byte table says which bytes belong to words, and a word's hash is a sum
over its bytes of table value times a power of its place in the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240117))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)

#: Bytes of words: all but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words: ASCII digits and lower-case letters, and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

#: Bytes that are hashed at a time.
_STEP = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    h = (h ^ (h >> _S30)) * _C1
    h = (h ^ (h >> _S27)) * _C2
    return h ^ (h >> _S31)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), _ODD, np.uint64)]), dtype=np.uint64)


_POWERS = _powers(4096)


class Words:
    """The words of some texts.

    data: the bytes (lower-cased A-Z if asked for); starts, ends: each word's
    bounds in data; first: index of each text's first word, and the total at the
    end; hashes: a 64-bit hash of each word. A null text has no words.
    """

    def __init__(self, texts: list[str | None], kind: np.ndarray = SPACED, lower: bool = False):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        if lower:
            data = _LOWER[data]
        inside = kind[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate([[0], edges])
        self.data, self.starts, self.ends = data, edges[0::2], edges[1::2]
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        global _POWERS
        starts, ends = self.starts, self.ends
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + _STEP)))
            lo, hi = int(starts[at]), int(ends[to - 1])
            lens = ends[at:to] - starts[at:to]
            if (most := int(lens.max())) > len(_POWERS):
                _POWERS = _powers(2 * most)
            heads = np.concatenate([[0], np.cumsum(lens)])[:-1]
            place = np.arange(int(lens.sum())) - np.repeat(heads, lens)
            byte = self.data[lo:hi][np.repeat(starts[at:to] - lo, lens) + place]
            out[at:to] = np.add.reduceat(_BYTE[byte] * _POWERS[place], heads)
            out[at:to] += lens.astype(np.uint64)
            at = to
        return mix(out)

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        """Number of words of each text."""
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), self.counts())

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive items of h; empty if there are fewer."""
    if len(h) < n:
        return np.empty(0, np.uint64)

    def poly(k: int) -> tuple[np.ndarray, np.uint64]:
        if k == 1:
            return h, _ODD
        half, p = poly(k // 2)
        m, size = k // 2, len(h) - 2 * (k // 2) + 1
        both, q = half[:size] * p + half[m : m + size], p * p
        if k % 2:
            return both[:-1] * _ODD + h[k - 1 :], q * _ODD
        return both, q

    with np.errstate(over="ignore"):
        return mix(poly(n)[0] + np.uint64(n))


def valid_starts(first: np.ndarray, n: int) -> np.ndarray:
    """True where n consecutive words begin that lie in one text; for rolling()."""
    total = int(first[-1])
    ok = np.ones(max(total - n + 1, 0), bool)
    for back in range(1, n):
        at = first[1:] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct n-word shingle hashes; a shorter text is one shingle."""
    grams = rolling(words.hashes, n)
    first = words.first
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield rolling(words.hashes[a:b], b - a)
        else:
            yield np.empty(0, np.uint64)
