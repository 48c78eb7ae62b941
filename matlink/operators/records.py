"""Ingest of material records: latest and first rows, rejection, quality of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], newest: str, tie: str) -> DataFrame:
    """The newest row of each key; of equal ones that with the highest tie."""
    order = Window.partitionBy(*keys).orderBy(F.desc(newest), F.desc(tie))
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def first(rows: DataFrame, keys: list[str], line: str) -> DataFrame:
    """The first row of each key in file order."""
    order = Window.partitionBy(*keys).orderBy(line)
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def accepted(rows: DataFrame) -> DataFrame:
    """Rows with a code and a text; the rest is rejected."""
    return rows.where((F.trim("legacy_code") != "") & (F.coalesce(F.nullif(F.trim("short_text"), F.lit("")), F.nullif(F.trim("long_text"), F.lit(""))).isNotNull()))


def changed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose code and content hash aren't known yet."""
    return rows.join(known.select("legacy_code", "content_hash"), ["legacy_code", "content_hash"], "left_anti")


def mean_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.bround(part / whole, 4))


def quality(rows: DataFrame) -> DataFrame:
    """One row of figures of a batch, in one pass, with a health score of five equal parts.

    rows: short_text, category, completeness, unit_state (ok, unknown or ambiguous), repeated
    (a later row of the same code).
    """
    own = ~F.col("repeated")
    n = F.count_if(own)
    full = F.count_if(own & (F.trim(F.coalesce("short_text", F.lit(""))) != ""))
    parts = rows.agg(
        n.alias("rows"),
        F.count_if(own & (F.length("short_text") > 40)).alias("over_40"),
        F.count_if("repeated").alias("repeated"),
        F.count_if(own & (F.col("unit_state") == "ambiguous")).alias("ambiguous"),
        mean_ratio(full, n).alias("descriptions"),
        mean_ratio(n, F.count("*")).alias("unique_codes"),
        mean_ratio(F.count_if(own & F.col("category").isNotNull()), n).alias("recognised"),
        F.coalesce(F.bround(F.avg(F.when(own & F.col("category").isNotNull(), F.col("completeness"))), 4), F.lit(0.0)).alias("completeness"),
        mean_ratio(F.count_if(own & (F.col("unit_state") == "ok")), n).alias("units"),
    )
    score = F.bround(100 * (F.col("descriptions") + F.col("unique_codes") + F.col("recognised") + F.col("completeness") + F.col("units")) / 5)
    return parts.withColumn("health", F.when(F.col("rows") > 0, score.cast("int")))


def suggested_mapping(headers: list[str], synonyms: dict[str, str]) -> tuple[dict[str, str], str | None]:
    """(header -> field, preset): each field at most once; SAP where three of its markers occur."""
    import re

    plain = lambda h: re.sub(r"[^a-z0-9]+", " ", h.lower()).strip()
    out: dict[str, str] = {}
    for header in headers:
        field = synonyms.get(plain(header))
        if field and field not in out.values():
            out[header] = field
    markers = {"matnr", "maktx", "meins", "matkl", "werks", "mfrnr", "mfrpn"}
    return out, "SAP" if len(markers & {w for h in headers for w in plain(h).split()}) >= 3 else None


def checked_mapping(mapping: dict[str, str], headers: list[str], fields: set[str]) -> dict[str, str]:
    """mapping, if it can be used; ValueError says what is wrong with it."""
    if stray := [h for h in mapping if h not in headers]:
        raise ValueError(f"not in the file: {', '.join(stray)}")
    if bad := sorted(set(mapping.values()) - fields):
        raise ValueError(f"unknown fields: {', '.join(bad)}")
    if len(set(mapping.values())) < len(mapping):
        raise ValueError("two columns map to one field")
    if "legacy_code" not in mapping.values() or not {"short_text", "long_text"} & set(mapping.values()):
        raise ValueError("legacy_code and a text are needed")
    return mapping
