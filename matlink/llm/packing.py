"""Packing of tokenised texts into training sequences by Karmarkar-Karp multiway differencing.

One pass over the partitions, without a shuffle. A partition's texts are tokenised as
they come. Runs of a whole sequence are cut from long texts; what remains of a text is a
piece. As soon as the held pieces fill a block of windows (the last is cut to fit, its
rest begins the next block), they are spread over as many: each piece begins as a partial
partition of its own, and the two partial partitions of the greatest imbalance are merged
so that the heavy windows of one meet the light ones of the other, until one is left with
near-equal windows. While a window exceeds the capacity, the window count rises and the
whole pieces are spread anew. So far no piece is cut. What the higher count leaves free is
then filled from the lightest windows, which are given up: their pieces go to the windows
with the least room for the whole of them, and are cut where there is none. Only the last
block of a partition isn't full, by less than a sequence.

Without cutting (cut=False) all windows of the higher count are kept.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matlink.llm.common import prepare

#: Texts of these characters only are encoded by the faster of two libraries with the same vocabulary.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7E¡-ɏ]*\Z")
_SPECIAL = "<|"
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def spread(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each piece, by multiway differencing; windows come out near-equal."""
    if windows <= 1 or not len(sizes):
        return np.zeros(len(sizes), np.int64)
    nodes: list[tuple] = [(i,) for i in range(len(sizes))]
    loads = [np.array([s], np.int64) for s in sizes.tolist()]
    heap = [(-int(s), i) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        x, y = loads[a], loads[b]  # descending; windows beyond them are empty
        size = min(windows, len(x) + len(y))
        both = np.zeros(size, np.int64)
        both[: len(x)] += x
        both[size - len(y) :] += y[::-1]
        order = np.argsort(-both, kind="stable")
        nodes.append((a, b, order, len(x), len(y)))
        loads[a] = loads[b] = None
        loads.append(both[order])
        most = int(loads[-1][0]) - (int(loads[-1][-1]) if size == windows else 0)
        heapq.heappush(heap, (-most, len(nodes) - 1))
    out = np.empty(len(sizes), np.int64)
    todo = [(heap[0][1], np.arange(len(loads[heap[0][1]])))]
    while todo:
        at, place = todo.pop()  # place: the window of each of the node's slots
        if len(nodes[at]) == 1:
            out[at] = place[0]
            continue
        a, b, order, nx, ny = nodes[at]
        slot = np.empty(len(order), np.int64)
        slot[order] = place
        todo.append((a, slot[:nx]))
        todo.append((b, slot[len(order) - ny :][::-1]))
    return out


def pack(sizes: np.ndarray, capacity: int, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (piece, start in it, length), none over capacity."""
    total = int(sizes.sum())
    if not total:
        return []
    if int(sizes.max()) > capacity:
        raise ValueError("a piece exceeds the capacity")
    least = count = -(-total // capacity)
    while True:
        window = spread(sizes, count)
        load = np.bincount(window, sizes, count).astype(np.int64)
        if load.max() <= capacity:
            break
        count += max(1, int((load > capacity).sum()) // 4)
    order = np.argsort(window, kind="stable")
    edges = np.searchsorted(window[order], np.arange(count + 1))
    out = [[(int(i), 0, int(sizes[i])) for i in order[a:z]] for a, z in zip(edges[:-1], edges[1:], strict=True)]
    if not cut or count == least:
        return [w for w in out if w]
    # the lightest windows beyond the least number fill what room the others have
    heavy = np.argsort(-load, kind="stable")
    poured = sorted((x for w in heavy[least:].tolist() for x in out[w]), key=lambda x: (-x[2], x[0]))
    room = sorted((capacity - int(load[w]), w) for w in heavy[:least].tolist())
    for i, start, n in poured:
        while n:
            at = min(bisect_left(room, (n, -1)), len(room) - 1)  # the least room for all of it, else the most
            free, w = room.pop(at)
            take = min(free, n)
            if take:
                out[w].append((i, start, take))
                start, n = start + take, n - take
            if free > take:
                insort(room, (free - take, w))
    return [out[w] for w in sorted(heavy[:least].tolist())]


class _Encoder:
    """Token ids of texts. Text that looks like a special token is ordinary text."""

    def __init__(self, tokenizer: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer)
        self.slow.encode_special_tokens = True
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and _SPECIAL not in text and _PLAIN.match(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1, block: int = 64, with_ids: bool = False) -> DataFrame:
    """Pieces of all texts: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    tokenizer: file of the `tokenizers` library; ranks: the same vocabulary for `tiktoken`,
    used for texts of plain Latin characters, on which both give the same ids. end_id ends
    every text. A null or empty text is that id alone. Rows with a null id and repeated rows
    are packed like all others. Other columns are ignored. A text's tokens are held at once.
    """
    prepare(docs.sparkSession)
    kind = _PIECE + (", ids array<int>" if with_ids else "")

    def run(frames):
        encode = _Encoder(tokenizer, ranks)
        number = (TaskContext.get().partitionId() << 36) if TaskContext.get() else 0
        held: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        size, rows = 0, []

        def give(window: list[tuple]):
            nonlocal number
            offset = 0
            for doc, start, ids, whole in window:
                row = (doc, start, len(ids), zlib.crc32(ids.tobytes()), whole, number, offset)
                rows.append((*row, ids.astype(np.int32)) if with_ids else row)
                offset += len(ids)
            number += 1

        def spread_out():
            nonlocal held, size
            for window in pack(np.array([len(h[2]) for h in held], np.int64), length):
                give([(held[i][0], held[i][1] + start, held[i][2][start : start + n], held[i][3]) for i, start, n in window])
            held, size = [], 0

        def frame():
            nonlocal rows
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            rows = []
            return out

        full = block * length
        for batch in frames:
            for doc, text in zip(batch["id"].tolist(), batch["text"].tolist(), strict=True):
                doc = None if pd.isna(doc) else int(doc)
                ids = np.append(encode(text or "").astype("<u4"), np.uint32(end_id)).astype("<u4", copy=False)
                whole, at = len(ids), 0
                for at in range(0, whole - length + 1, length):
                    give([(doc, at, ids[at : at + length], whole)])
                at = whole // length * length
                while at < whole:
                    n = min(whole - at, full - size)
                    held.append((doc, at, ids[at : at + n], whole))
                    size, at = size + n, at + n
                    if size == full:
                        spread_out()
                if len(rows) > 20_000:
                    yield frame()
        spread_out()
        if rows:
            yield frame()

    pieces = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, kind)
    return pieces.withColumnRenamed("doc_id", id_col)


def public_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_files())
