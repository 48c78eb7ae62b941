"""Crosswalk exports: text files an org, with byte order mark, preamble and CRLF, written by tasks.

Rows are dealt by range of (org, order), so an org's rows lie in one file or, where they are many, in
several that follow each other; each file has its own preamble and header. Lines are made by
native expressions; a task only puts the head before the first line of each file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matlink.functions.canonical import python_number
from matlink.functions.text import safe_cell
from matlink.sources.policy import literal_map

# ---- fixed values ----
CROSSWALK_COLUMNS = ["cnmc", "cnmc_short_desc_40", "category", "cpse", "legacy_code", "legacy_short_text", "relation", "uom", "uom_factor", "migration_action", "status"]
SAP_COLUMNS = ["MATNR", "ZZ_CNMC", "MAKTX_NATIONAL", "MEINS", "UMREZ", "MSTAE_RECOMMENDED", "WERKS_NOTE"]
SAP_STATUS = {"RETAIN": "", "BLOCK_FOR_NEW_PROCUREMENT": "BLOCK", "PHASE_OUT_WHEN_STOCK_ZERO": "PHASE_OUT"}

_ORG, _FILE_ROWS = "_org", 1_000_000
_BOM = "\ufeff"


def cell(value: Column, kind: str, sep: str) -> Column:
    """A cell of a line: null is empty, texts are guarded against formulas and quoted where they must be."""
    if kind == "string":
        text = safe_cell(value)
    elif kind in ("double", "float"):
        text = python_number(value.cast("double"))
    else:
        text = value.cast("string")
    text = F.coalesce(text, F.lit(""))
    return F.when(text.contains(sep) | text.rlike('["\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def line(rows: DataFrame, columns: Sequence[str], sep: str) -> Column:
    """A row's cells; one that starts a line with # is quoted, so that it doesn't read as a preamble."""
    kinds = dict(rows.dtypes)
    first, *rest = (cell(F.col(f"`{c}`"), kinds[c], sep) for c in columns)
    return F.concat_ws(sep, F.when(first.startswith("#"), F.concat(F.lit('"'), first, F.lit('"'))).otherwise(first), *rest)


def sap(rows: DataFrame) -> DataFrame:
    """Crosswalk rows under the names of SAP's fields."""
    status = F.coalesce(literal_map(SAP_STATUS)[F.coalesce("migration_action", F.lit(""))], F.lit(""))
    source = ["legacy_code", "cnmc", "cnmc_short_desc_40", "uom", "uom_factor", None, "cpse"]
    return rows.select("*", *((status if s is None else F.col(s)).alias(c) for c, s in zip(SAP_COLUMNS, source, strict=True)))


def write_export(rows: DataFrame, path: str, kind: str = "csv", preamble: str | None = None, file_rows: int = _FILE_ROWS) -> DataFrame:
    """Writes the active rows of a crosswalk to path/_org=<org>/, in order of cnmc and legacy code; returns (org, rows).

    rows has CROSSWALK_COLUMNS, others are ignored. kind: csv, sap_csv (semicolons, SAP's fields) or json (a line a
    row, without head). Files hold near file_rows rows; their names follow the order. Null orgs go to
    Spark's default partition. An existing path is an error.
    """
    if kind not in ("csv", "sap_csv", "json"):
        raise ValueError(f"unknown kind {kind}")
    active = rows.where("status = 'ACTIVE'").select(*CROSSWALK_COLUMNS)
    order = [F.col("cpse"), F.col("cnmc"), F.col("legacy_code")]
    parts = max(1, -(-active.count() // file_rows))
    if kind == "json":
        text, head = F.to_json(F.struct(*CROSSWALK_COLUMNS), {"ignoreNullFields": "false"}), ""
    else:
        sep, columns = (";", SAP_COLUMNS) if kind == "sap_csv" else (",", CROSSWALK_COLUMNS)
        shown = sap(active) if kind == "sap_csv" else active
        text, active = line(shown, columns, sep), shown
        head = _BOM + (f"# {preamble}\n" if preamble else "") + sep.join(columns) + "\r\n"
    lines = active.select(*order, text.alias("value")).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, any_ = None, False
        for frame in frames:
            if not len(frame):
                continue
            org = frame["cpse"].where(frame["cpse"].notna(), None)
            before = org.shift(1)
            before.iloc[0] = last
            new = (org != before) & ~(org.isna() & before.isna())
            if not any_:
                new.iloc[0], any_ = True, True
            last = org.iloc[-1]
            frame["value"] = frame["value"].where(~new, head + frame["value"])
            yield pd.DataFrame({_ORG: org, "value": frame["value"]})

    made = lines.mapInPandas(files, f"{_ORG} string, value string")
    made.write.partitionBy(_ORG).option("lineSep", "\r\n" if kind != "json" else "\n").text(path)
    return rows.where("status = 'ACTIVE'").groupBy(F.col("cpse").alias("org")).agg(F.count("*").alias("rows"))


def read_export(spark: SparkSession, path: str, kind: str = "csv", preamble: bool = False) -> DataFrame:
    """The rows of an export as texts, with org; blank cells are null. Cells may hold line breaks; guards stay.

    preamble: whether files have one. It ends in a single line feed, so it and the header are one comment here.
    """
    if kind == "json":
        return spark.read.schema(", ".join(f"{c} {'double' if c == 'uom_factor' else 'string'}" for c in CROSSWALK_COLUMNS)).json(path)
    sep, columns = (";", SAP_COLUMNS) if kind == "sap_csv" else (",", CROSSWALK_COLUMNS)
    schema = ", ".join(f"`{c}` string" for c in [*columns, _ORG])
    rows = spark.read.schema(schema).options(sep=sep, header=not preamble, comment="#", multiLine=True, escape='"', quote='"', nullValue="", lineSep="\r\n").csv(path)
    return rows.withColumnRenamed(_ORG, "org")
