"""Verification of attribute answers that a model gave for texts: nothing unproven is taken over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matlink.functions.text import normaliser
from matlink.operators.extract import specs
from matlink.operators.graph import cut

# Allowed values of attributes, and attributes that are whole numbers.
DOMAINS = {
    "valve_type": ("GATE", "GLOBE", "CHECK", "BALL", "BUTTERFLY"), "end_connection": ("FLANGED-RF", "FLANGED-FF", "FLANGED-RTJ", "BW", "SW", "THRD"), "process": ("SEAMLESS", "WELDED"),
    "flange_type": ("WN", "SO", "BLIND", "LJ", "SW", "THRD"), "face": ("RF", "FF", "RTJ"), "fastener_type": ("BOLT", "STUD", "NUT", "SCREW"), "filler": ("GRAPHITE", "PTFE"),
    "pressure_class": ("150", "300", "600", "900", "1500", "2500"),
}
WHOLE = ("size_dn", "pressure_class", "length_mm", "poles", "rpm", "voltage")


def missing_core(category: Column, attrs: Column, core: Column) -> Column:
    """Core attributes that a spec lacks."""
    return F.when(category.isNotNull(), F.filter(core, lambda a: F.try_element_at(attrs, a).isNull()))


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(text), r"\s+", " "))


def coerced(attr: Column, value: Column) -> Column:
    """The value as the attribute's type writes it, null where it isn't of the type or the domain."""
    text = F.upper(F.trim(value))
    number = text.try_cast("double")
    whole = F.when(F.abs(number) < 1e15, F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("string"))
    out = F.when(attr.isin(*WHOLE), whole).when(attr == "power_kw", F.when(F.abs(number) < float("inf"), number.cast("string"))).otherwise(F.nullif(text, F.lit("")))
    allowed = F.create_map(*(c for name, values in DOMAINS.items() for c in (F.lit(name), F.array(*map(F.lit, values)))))[attr]
    return F.when(allowed.isNull() | F.array_contains(allowed, F.coalesce(out, F.lit(""))), out)


def verified(answers: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, attr, value, tier, confidence) of the answers (id, attr, value, span) that hold for rows (id, text, category).

    The span has to stand in the text, the value to be of the attribute's type and domain, and the rules, reading the
    category and the span alone, may not read another value; where they read one, it is taken as they write it.
    """
    told = answers.join(rows.select("id", "text", "category"), "id")
    told = told.withColumn("v", coerced(F.col("attr"), F.col("value"))).where("v is not null and category is not null and trim(span) <> ''")
    told = told.where(F.contains(_flat(F.col("text")), _flat(F.col("span"))))
    alone = told.select("category", "span").distinct().withColumn("key", F.struct("category", "span"))
    norm = alone.select("key", normaliser()(F.concat_ws(" ", "category", "span")).alias("n")).select("key", F.col("n.text").alias("norm_text"))
    ruled = cut(specs(norm, "key").select("id", "category", "attrs")).select(F.col("id.category").alias("category"), F.col("id.span").alias("span"), F.when(F.col("category") == F.col("id.category"), F.col("attrs")).alias("read"))
    read = F.try_element_at(F.col("read"), F.col("attr"))
    kept = told.join(ruled, ["category", "span"], "left").withColumn("read", read)
    same = F.col("read").isNull() | (F.col("read") == F.col("v")) | (F.col("read").try_cast("double") == F.col("v").try_cast("double"))
    return kept.where(same).select("id", "attr", F.coalesce("read", "v").alias("value"), F.lit("LLM").alias("tier"), F.lit(0.9).alias("confidence"))
