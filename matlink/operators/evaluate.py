"""Confusion metrics with honest bounds, threshold grids and blocking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_Z = 1.96


def upper_bound(k: Column, n: Column) -> Column:
    """95 % upper bound of a rate k of n: the rule of three for none, Wilson's otherwise."""
    p = k / n
    wide = (p + _Z * _Z / (2 * n) + _Z * F.sqrt(p * (1 - p) / n + _Z * _Z / (4 * n * n))) / (1 + _Z * _Z / n)
    return F.when(n == 0, 1.0).when(k == 0, F.least(F.lit(1.0), 3 / n)).otherwise(F.least(F.lit(1.0), wide))


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of rows with truth and positive (booleans) and decided (boolean), by groups."""
    hit = F.col("positive") & F.col("decided")
    out = rows.groupBy(*by).agg(
        F.count_if(hit & F.col("truth")).alias("tp"),
        F.count_if(hit & ~F.col("truth")).alias("fp"),
        F.count_if(~F.col("positive") & F.col("decided") & F.col("truth")).alias("fn"),
        F.count_if(~F.col("decided")).alias("abstained"),
        F.count_if("truth").alias("positives"),
        F.count("*").alias("pairs"),
    )
    return out.select(
        *by, "tp", "fp", "fn", "abstained", "pairs",
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide(F.col("tp"), F.col("positives")).alias("strict_recall"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("decided_recall"),
        F.try_divide(F.col("pairs") - F.col("abstained"), F.col("pairs")).alias("coverage"),
        upper_bound(F.col("fp"), F.col("tp") + F.col("fp")).alias("false_merge_upper"),
    )


def threshold_grid(rows: DataFrame, lowest: int = 50, highest: int = 99, prefer_low: bool = True) -> DataFrame:
    """(tau, tp, fp, fn, f1, best) for tau in hundredths; rows have truth and score.

    The scores are counted by hundredths first, so a row meets a threshold once.
    """
    counts = rows.groupBy(F.floor(F.round(F.col("score") * 100, 6)).cast("int").alias("at")).agg(F.count_if("truth").alias("t"), F.count_if(~F.col("truth")).alias("f"))
    taus = rows.sparkSession.range(lowest, highest + 1).select(F.col("id").cast("int").alias("tau"))
    over = F.col("at") >= F.col("tau")
    grid = taus.crossJoin(counts).groupBy("tau").agg(  # at most 101 counts for each of 50 thresholds
        F.sum(F.when(over, F.col("t")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("f")).otherwise(0)).alias("fp"), F.sum(F.when(~over, F.col("t")).otherwise(0)).alias("fn")
    )
    grid = grid.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))
    tie = -F.col("tau") if prefer_low else F.col("tau")
    best = grid.agg(F.max_by("tau", F.struct(F.round("f1", 12), tie)).alias("best_tau"))
    return grid.crossJoin(F.broadcast(best)).withColumn("best", F.col("tau") == F.col("best_tau")).drop("best_tau")


def blocking(truth: DataFrame, candidates: DataFrame, records: int) -> DataFrame:
    """Share of true pairs that candidates hold, and of all pairs that they are."""
    reached = truth.join(candidates.select("id_a", "id_b"), ["id_a", "id_b"], "left_semi").count()
    return truth.agg(F.count("*").alias("true_pairs")).select("true_pairs", F.lit(reached).alias("reached"), F.try_divide(F.lit(reached), F.col("true_pairs")).alias("completeness"), F.lit(candidates.count() / max(records * (records - 1) / 2, 1)).alias("share_of_pairs"))
