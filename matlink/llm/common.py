"""Small helpers that the operators share: batches of texts, memory, bitmaps."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matlink.operators.graph import components, cut, shared_dir


__all__ = ["batches", "bitmap", "buckets_for", "components", "cut", "free_name", "prepare", "release", "shared_dir", "with_likely"]

try:
    _LIBC = ctypes.CDLL("libc.so.6") if hasattr(ctypes.CDLL("libc.so.6"), "malloc_trim") else None
except OSError:  # another C library
    _LIBC = None


#: Rows of an Arrow batch, unless the session sets another number than Spark's own.
_BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches for long texts: a worker holds a batch several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(_BATCH_ROWS))


def release() -> None:
    """Gives freed memory of this worker back to the system."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def batches(table_batch, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows whose texts (a list) hold about limit characters at most, or one row.

    Memory is given back when all runs are done.
    """
    start = size = 0
    for i, t in enumerate(table_batch):
        n = len(t) if t is not None else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(table_batch):
        yield start, len(table_batch)
    release()


def free_name(columns: list[str], name: str) -> str:
    """name, or a longer one, that none of columns starts with in any case: for a helper column beside a caller's."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name += "_"
    return name


def buckets_for(docs: DataFrame, text_col: str, least: int, bytes_each: int) -> int:
    """How many buckets hold near bytes_each bytes of all texts: more text makes more buckets, not larger ones."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(least, -(-size // bytes_each))


def bitmap(ids: DataFrame, column: str, log2_bits: int = 23, hashed: bool = True) -> np.ndarray:
    """A bitmap of fixed size with the bit of every value set (a one-hash Bloom filter).

    hashed=False: the values are hashes already, and their high bits are taken.

    At most 2**log2_bits / 64 rows of two longs reach the driver, whatever the input.
    """
    bit = F.shiftrightunsigned(F.xxhash64(F.col(column)) if hashed else F.col(column), 64 - log2_bits)
    rows = (
        ids.select(bit.alias("bit"))
        .groupBy(F.shiftrightunsigned("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(1 << (log2_bits - 6), np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out


def with_likely(df: DataFrame, name: str, key: Column, ids: DataFrame, column: str, log2_bits: int = 23) -> DataFrame:
    """df with column name: true for every key among the long column of ids, and for few others.

    Told by a bitmap of fixed size: at most 2**log2_bits / 64 rows are broadcast, whatever the
    number of ids. With it, only rows that need a join are shuffled. Null keys are false.
    name may not be a column of df, see free_name.
    """
    own = free_name([*df.columns, name], "__likely")
    bit, word, bits = (f"{own}{k}" for k in range(3))
    place = lambda k: F.shiftrightunsigned(F.xxhash64(k), 64 - log2_bits)
    words = ids.where(F.col(column).isNotNull()).select(place(F.col(column)).alias("bit"))
    words = words.groupBy(F.shiftrightunsigned("bit", 6).alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias(bits))
    df = df.withColumn(bit, F.when(key.isNotNull(), place(key)))
    hit = F.expr(f"coalesce((shiftrightunsigned({bits}, CAST({bit} & 63 AS INT)) & 1) = 1, false)")
    return df.join(F.broadcast(words), F.shiftrightunsigned(bit, 6) == F.col(word), "left").withColumn(name, hit).drop(bit, word, bits)
