"""Overviews of organisations and groups, the review queue, and who may read which notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: stage -> state of the task. Fixed values.
STAGES = {"to_propose": "OPEN", "to_check": "MADE", "awaiting_consent": "AWAITING_CONSENT", "done": "DONE"}


def organisations(records: DataFrame, batches: DataFrame, members: DataFrame) -> DataFrame:
    """One row an org that has records: their number, spend, health of its latest judged batch, records in groups.

    records: id, org, annual_value. batches: batch, org, created, health (null: not judged). members: id, org.
    Each figure is a correlated subquery, which Spark turns into a grouped join.
    """
    return records.sparkSession.sql(
        """WITH own AS (SELECT org, count(*) AS records, coalesce(sum(annual_value), 0) AS spend FROM {records} WHERE org IS NOT NULL GROUP BY org)
        SELECT o.org, o.records, o.spend,
          (SELECT max_by(b.health, struct(b.created, b.batch)) FROM {batches} AS b WHERE b.org = o.org AND b.health IS NOT NULL) AS health,
          (SELECT count(DISTINCT m.id) FROM {members} AS m WHERE m.org = o.org) AS in_groups
        FROM own AS o""",
        records=records, batches=batches, members=members,
    )


def groups(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """clusters with size, orgs (in order, by comma), title (the smallest text) and value of their members.

    clusters: cluster and any others. members: cluster, org, text, annual_value. A cluster without members has size 0.
    """
    return clusters.sparkSession.sql(
        """SELECT c.*, (SELECT count(*) FROM {members} AS m WHERE m.cluster = c.cluster) AS size,
          (SELECT array_join(array_sort(collect_set(m.org)), ',') FROM {members} AS m WHERE m.cluster = c.cluster) AS orgs,
          (SELECT min(m.text) FROM {members} AS m WHERE m.cluster = c.cluster) AS title,
          (SELECT coalesce(sum(m.annual_value), 0) FROM {members} AS m WHERE m.cluster = c.cluster) AS value
        FROM {clusters} AS c""",
        clusters=clusters, members=members,
    )


def relations(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, relation): IDENTICAL where all decided pairs inside a cluster are, and there is one; else EQUIVALENT.

    pairs: rec_a, rec_b, verdict, and cluster where it is known that both sides are in it. members: cluster, id. Only pairs whose
    two sides share a cluster are grouped.
    """
    inside = pairs
    if "cluster" not in pairs.columns:
        a = members.select(F.col("id").alias("rec_a"), "cluster")
        b = members.select(F.col("id").alias("rec_b"), F.col("cluster").alias("other"))
        inside = pairs.join(a, "rec_a").join(b, "rec_b").where("cluster = other")
    same = inside.groupBy("cluster").agg(F.bool_and(F.col("verdict") == "IDENTICAL").alias("same"))
    every = members.select("cluster").distinct()
    return every.join(same, "cluster", "left").select("cluster", F.when(F.coalesce("same", F.lit(False)), "IDENTICAL").otherwise("EQUIVALENT").alias("relation"))


def in_queue(me: int | str, stage: str | None = None, category: str | None = None, critical: bool | None = None) -> Column:
    """Tasks (state, made_by, category, critical) of a stage that a user may take: nobody checks what they made."""
    out = F.lit(True)
    if stage is not None:
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage}")
        out = F.col("state") == STAGES[stage]
        if stage == "to_check":
            out = out & ~F.col("made_by").eqNullSafe(F.lit(me))
    if category is not None:
        out = out & (F.col("category") == category)
    return out if critical is None else out & (F.col("critical") == critical)


def notice_scope(role: Column, own: Column, asked: Column, known: Column) -> Column:
    """struct(org, error): whose notices a user reads. Makers and checkers read their own org's; others name one.

    known: is there an org of the code that was asked for.
    """
    bound = role.isin("MAKER", "CHECKER")
    given = F.nullif(asked, F.lit(""))
    error = (
        F.when(bound & (own.isNull() | (given != own)), "FORBIDDEN")
        .when(~bound & given.isNull(), "NO_ORG")
        .when(~bound & ~F.coalesce(known, F.lit(False)), "NOT_FOUND")
    )
    return F.struct(F.when(error.isNull(), F.when(bound, own).otherwise(given)).alias("org"), error.alias("error"))
