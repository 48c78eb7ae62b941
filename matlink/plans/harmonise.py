"""A whole harmonisation run: records to specs, candidates, decisions and groups, each a dataset of the run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matlink.functions.similarity import token_set_similarity
from matlink.functions.text import record_text, tokens
from matlink.operators import candidates as C
from matlink.operators import kinds
from matlink.operators.cluster import blocked_witness
from matlink.operators.decide import decide, lookalike, sides, stored_evidence, vetoes
from matlink.operators.extract import text_specs
from matlink.operators.graph import cut
from matlink.plans.items import GROUPS_SQL
from matlink.plans.views import item_part_number, item_texts


@dataclass(frozen=True)
class Run:
    specs: DataFrame
    pairs: DataFrame
    members: DataFrame
    blocked: DataFrame


def run(records: DataFrame, mode: str = "CROSS", lexical_k: int = 200, block_cap: int | None = None, auto: bool = False, vectors: DataFrame | None = None, dense_k: int = 20, size_cap: int | None = None) -> Run:
    """All stages over records: id, org, short_text, long_text, maker, mpn, critical. Ids are unique longs.

    auto=False sends every positive pair to review. A CROSS run needs two orgs. vectors (id,
    vector) adds a channel: those of each record's dense_k nearest of its category that mode allows. Blocks are compared whole and groups have any
    size, unless block_cap (records of larger blocks meet their lexical_k nearest texts) or size_cap are given: the surveyed project has
    2000 and 200. Records without a block meet their nearest texts in any case.

    Groups come from decisions on kinds of records (see operators/kinds.py); pairs are listed and decided when they are read.
    """
    if mode == "CROSS" and records.select("org").distinct().limit(2).count() < 2:
        raise ValueError("a run across organisations needs two of them")
    made = text_specs(records.select("id", record_text(F.col("long_text"), F.col("short_text")).alias("text"), "org", "maker", "mpn", "critical"))
    made = cut(made.withColumn("block", C.block_value(F.col("category"), F.col("attrs"))).withColumn("tokens", tokens(F.col("norm_text"))))
    found = {"B": C.block_pairs(made, mode, block_cap), "M": C.part_number_pairs(made, mode)}
    queries = cut(C.unblocked(made, block_cap).select("id").distinct())
    near = {}
    if not queries.isEmpty():
        near["L"] = C.lexical_neighbours(made.where("category is not null"), made.join(queries, "id", "left_semi"), lexical_k, mode)
    if vectors is not None:
        nearest = C.dense_neighbours(made.where("category is not null").select("id", "category").join(vectors.where("vector is not null"), "id"), dense_k)
        a, b = (made.select(F.col("id").alias(f"id_{x}"), F.col("org").alias(f"org_{x}")) for x in "ab")
        near["D"] = nearest.join(a, "id_a").join(b, "id_b").where(C.allowed(F.col("org_a"), F.col("org_b"), mode))
    near = {letter: cut(df.select("id_a", "id_b")) for letter, df in near.items()}
    pairs = decide(sides(C.merged(**found, **near), made))
    pairs = pairs.withColumn("text_sim", F.round(token_set_similarity("a_norm_text", "b_norm_text"), 4)).withColumn("evidence", stored_evidence(F.col("evidence")))
    route = F.col("route") if auto else F.when(F.col("route") == "AUTO_ELIGIBLE", "REVIEW").otherwise(F.col("route"))
    pairs = pairs.select("id_a", "id_b", "channels", "verdict", route.alias("route"), "confidence", "text_sim", lookalike(F.col("verdict"), F.col("text_sim")).alias("lookalike"), "reasons", "evidence")
    blocks = made
    if block_cap is not None:
        met = made.join(queries.withColumn("over", F.lit(True)), "id", "left")
        blocks = met.withColumn("block", F.when(F.col("over").isNull(), F.col("block"))).select(*made.columns)
    k = kinds.kinds(blocks)
    others = cut(_others(k, kinds.number_only(k, mode=mode), near))
    members, blocked, classes = kinds.groups(k, cut(kinds.decided(k, numbers=others)), others, size_cap, mode)
    if blocked is None:
        none = records.sparkSession.createDataFrame([], "i long, j long, score double, reason string, x long, y long")
        return Run(made, pairs, members, none)
    return Run(made, pairs, members, blocked_witness(blocked, members, vetoes(k.specs), classes))


def _others(k: kinds.Kinds, numbers: DataFrame, near: dict[str, DataFrame]) -> DataFrame:
    """(id_a, id_b, x, y, same) of all candidates that share no block, each once: those of part numbers, and of near (id_a, id_b)."""
    out = numbers.withColumn("same", F.lit(True))
    if near:
        met = C.merged(**near).select("id_a", "id_b").join(numbers.select("id_a", "id_b"), ["id_a", "id_b"], "left_anti")
        for side, kind in (("a", "x"), ("b", "y")):
            met = met.join(k.members.select(F.col("id").alias(f"id_{side}"), F.col("kind").alias(kind), F.col("at").alias(f"at_{side}"), F.col("pn").alias(f"pn_{side}")), f"id_{side}")
        met = met.where("not coalesce(at_a = at_b, false)")
        out = out.unionByName(met.select("id_a", "id_b", "x", "y", F.coalesce(F.col("pn_a") == F.col("pn_b"), F.lit(False)).alias("same")))
    return out


def harmonise_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a whole run over the items."""
    none = F.lit(None)
    records = item_texts(spark, sf_dir).select("id", F.col("style").cast("string").alias("org"), F.col("text").alias("short_text"), none.cast("string").alias("long_text"), *item_part_number(), none.cast("boolean").alias("critical"))
    return run(records).members


QUERIES = {"harmonise_run": harmonise_run}
ORACLE_SQL = {"harmonise_run": GROUPS_SQL}
