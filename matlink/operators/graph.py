"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Links in a file of a round.
_FILE_LINKS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where none is set (tests, local mode)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return where or f"file://{tempfile.gettempdir()}/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder, so that lost executors cost nothing."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written as a table at path and read from there.

    For tables that joins of many rounds make from each other: a checkpoint passes the planner's estimate of its size
    on, and the product of all these takes longer than the work; a file's size is its own.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, on whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of undirected links (a, b) of longs; component is the smallest node.

    Each round (Kiveris et al. 2014) is a grouped minimum and a join, and is checkpointed, in as few files as
    its links need. Nodes without links to others don't appear.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    now = state(edges)
    for _ in range(max_rounds):
        if not now[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(edges.coalesce(-(-now[0] // _FILE_LINKS)))  # never more links than before
        then, now = now, state(edges)
        if then == now:
            break
    else:
        raise RuntimeError("components did not settle")
    if not now[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    rows = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return rows.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
