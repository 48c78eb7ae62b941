"""Whitening of embeddings: principal components by Spark MLlib's computeSVD on centred distributed rows.

1. Entries become whole numbers, so sums over the fit list (each distinct vector once) are exact.
2. Every task centres its rows as (n x - S) / n, where n x - S is exact, before anything is
   multiplied. RowMatrix.computeSVD of these rows gives the components; a singular value squared
   over n, the divisor, is an eigenvalue of the covariance.
3. The total variance comes from the exact deviations instead: the sum of (n x - S)**2 over the
   fit list, over n**3.
4. The covariance of the whitened fit list is taken in another pass and held against the identity.

Only sums a dimension and matrices of dimensions x dimensions reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matlink.llm.common import cut, prepare

#: Singular values below this share of the first are rounding, not variance.
_LEAST = 1e-6
#: Sums and products below this are exact in 64 bits; others are made of Python's integers.
_SAFE = 2**62


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(id, x) of the rows with a whole vector: x = floor(scale * entry) + shift, as longs.

    Rows go whose vector is null, empty, holds null or non-finite entries, or has another length
    than most vectors (of equally frequent lengths, the largest counts).
    """
    vector = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    kept = rows.select(F.col(id_col).alias("id"), vector.alias("v")).where("size(v) > 0").where(~bad)
    length = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return kept.where(F.size("v") == (length[0] if length else 0)).select("id", F.transform("v", lambda c: (F.floor(c * scale) + shift).cast("long")).alias("x"))


def _stacked(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(np.int64)


def _total(m: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    return m.sum(axis=0, dtype=np.int64 if int(np.abs(m).max()) * len(m) < _SAFE else object).tolist()


def shifted(m: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: in 64 bits, or as Python's integers where these don't hold it."""
    if int(np.abs(m).max()) * n + max(map(abs, sums)) < _SAFE:
        return m * n - np.asarray(sums, np.int64)
    return m.astype(object) * n - np.asarray(sums, object)


def deviations(d: np.ndarray) -> list[int]:
    """Exact sum of squares of each row."""
    top = int(np.abs(d).max())
    return ((d if top * top * d.shape[1] < _SAFE else d.astype(object)) ** 2).sum(axis=1).tolist()


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums S; components (columns) with eigenvalues; total: the trace of the covariance.

    rows: id, deviation (decimal, exact) and whitened (array, an entry a component) of all rows.
    """

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    total: float
    identity_error: float
    rows: DataFrame


def _summed(rows: DataFrame) -> dict[int, float]:
    return {r[0]: r[1] for r in rows.groupBy("place").agg(F.sum("value")).collect()}


def whiten(rows: DataFrame, id_col: str, vector_col: str, components: int = 16, scale: int = 64, shift: int = 1_000_000) -> Whitening:
    """Whitens all rows with a whole vector (see whole_vectors), fitted on each distinct vector once.

    Components are unit vectors by falling eigenvalue, as many as asked for or as have variance;
    their largest entry is positive, so signs don't depend on the run. Components of equal
    eigenvalues are any basis of theirs. A table without rows, or with one distinct vector, has
    none, and its rows have an empty whitened array. Repeated ids and null ids are kept.
    Other columns are ignored. Deviations have 38 digits at most.
    """
    spark = rows.sparkSession
    prepare(spark)
    whole = whole_vectors(rows, id_col, vector_col, scale, shift)
    fit = cut(whole.select("x").distinct())

    def add(frames):
        n, sums = 0, None
        for x in (frame["x"] for frame in frames if len(frame)):
            own = _total(_stacked(x))
            n, sums = n + len(x), own if sums is None else [a + b for a, b in zip(sums, own, strict=True)]
        if n:
            yield pd.DataFrame({"place": range(-1, len(sums)), "value": [Decimal(v) for v in (n, *sums)]})

    got = _summed(fit.mapInPandas(add, "place int, value decimal(38,0)"))
    n, sums = int(got.pop(-1, 0)), [int(got[k]) for k in sorted(got)]

    def centred(frames):
        for frame in frames:
            if len(frame):
                d = shifted(_stacked(frame["x"]), n, sums)
                yield pd.DataFrame({"c": list(d.astype(float) / n), "deviation": [float(v) for v in deviations(d)]})

    base = cut(fit.mapInPandas(centred, "c array<double>, deviation double")) if n > 1 else None
    total = base.agg(F.sum("deviation")).first()[0] / n**3 if base else 0.0
    vectors, values = np.zeros((len(sums), 0)), np.zeros(0)
    if total > 0:
        # All dimensions are asked for, so that MLlib decomposes to double precision instead of iterating.
        matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(base.select(array_to_vector("c").alias("c")), "c"), n, len(sums))
        svd = matrix.computeSVD(len(sums), computeU=False, rCond=_LEAST)
        vectors, values = svd.V.toArray()[:, :components], (svd.s.toArray() ** 2 / n)[:components]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    scaled, k = vectors / np.sqrt(values), len(values)

    def gram(frames):
        first, second = np.zeros(k), np.zeros((k, k))
        for frame in frames:
            if len(frame):
                w = np.stack(frame["c"].to_numpy()) @ scaled
                first, second = first + w.sum(axis=0), second + w.T @ w
        yield pd.DataFrame({"place": range(k + k * k), "value": np.concatenate([first, second.ravel()])})

    error = 0.0
    if k:
        got = _summed(base.select("c").mapInPandas(gram, "place int, value double"))
        flat = np.array([got[i] for i in range(k + k * k)]) / n
        error = float(np.abs(flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)).max())

    @F.pandas_udf("deviation decimal(38,0), whitened array<double>")
    def project(x: pd.Series) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"deviation": [], "whitened": []})
        d = shifted(_stacked(x), n, sums)
        return pd.DataFrame({"deviation": [Decimal(v) for v in deviations(d)], "whitened": list(d.astype(float) / n @ scaled)})

    done = whole.select(F.col("id").alias(id_col), project("x").alias("own")).select(id_col, "own.deviation", "own.whitened")
    return Whitening(n, sums, vectors, values, total, error, done)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their 16 first components, whitened; a deviation beyond 64 bits is null."""
    fit = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    shares = F.array(*(F.lit(float(v / fit.total)) for v in fit.eigenvalues)).cast("array<double>")
    rows = fit.rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), F.expr("try_cast(deviation AS long)").alias("deviation"),
        "whitened", shares[F.col("at")].alias("explained"), F.lit(fit.identity_error).alias("identity_error"),
    )
