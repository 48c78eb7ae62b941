"""Delimited files in and out, whole-file idempotence, and guarded exports."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matlink.functions.text import safe_cell
from matlink.sources.encoding import decoded, detect

_SEPARATORS = ",;\t|"
_SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_WIDE = {"utf-8": "UTF-8", "utf-16": "UTF-16"}


def plain_header(name: str) -> str:
    """A header without punctuation and case: two headers of a file may not be equal in it."""
    return re.sub(r"[^a-z0-9]+", " ", name.lower()).strip()


def header(line: str) -> tuple[str, list[str]]:
    """Separator and column names of a first line; a blank name becomes column N. ValueError for equal names."""
    sep = max(_SEPARATORS, key=line.count)
    names = [h.strip() or f"column {i + 1}" for i, h in enumerate(next(csv.reader([line], delimiter=sep), []))]
    if len({plain_header(n) for n in names}) < len(names):
        raise ValueError("two columns have the same name")
    return sep, names


def _trimmed(cell: Column) -> Column:
    """A cell without white space (Unicode's) around it, null if nothing is left."""
    return F.nullif(F.btrim(cell, F.lit(_SPACE)), F.lit(""))


def read_delimited(spark: SparkSession, path: str, choose: Callable[[list[str]], dict[str, str]] | None = None, fields: list[str] | None = None, corrupt: str | None = None) -> DataFrame:
    """All rows of the files under path as trimmed texts; blank rows are dropped, blank and missing cells are null.

    Encoding, separator and columns are told for each file; files of other columns have nulls in theirs. A file is
    read in splits, unless its quotes span lines. A name twice in a file, or files without rows, are a ValueError.
    choose: names of a file -> field and name of each column that is wanted; fields are then the columns. corrupt:
    a column with the whole line where its cells don't fit the names, else null.
    """
    kinds: dict[tuple, list[str]] = {}
    for r in detect(spark, path).collect():  # a row a file, as Spark's own list of files
        text = bytes(r.head or b"").decode(r.encoding, "ignore").lstrip("\ufeff")
        first = next((x for x in text.splitlines() if x.strip()), None)
        if first is not None:
            sep, names = header(first)
            kinds.setdefault((r.encoding, sep, tuple(names), r.open_quotes or r.encoding == "utf-16"), []).append(r.file)
    if not kinds:
        raise ValueError("the files have no rows")
    out = None
    for (encoding, sep, names, lines), files in kinds.items():
        schema = ", ".join([*(f"`c{i}` string" for i in range(len(names))), *([f"`{corrupt}` string"] if corrupt else [])])
        options = {"columnNameOfCorruptRecord": corrupt or "_", "columnPruning": not corrupt, "header": True, "sep": sep, "encoding": _WIDE.get(encoding, "ISO-8859-1"), "mode": "PERMISSIVE", "multiLine": lines, "escape": '"'}
        rows = spark.read.schema(schema).options(**options).csv(files)
        cell = (lambda c: F.col(c)) if encoding in _WIDE else (lambda c, e=encoding: decoded(F.col(c), e))
        wanted = choose(list(names)) if choose else {n: n for n in names}
        cells = [(_trimmed(cell(f"c{names.index(wanted[f])}")) if f in wanted else F.lit(None).cast("string")).alias(f) for f in fields or wanted]
        rows = rows.select(*cells, *([cell(corrupt).alias(corrupt)] if corrupt else [])).na.drop("all")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def new_files(spark: SparkSession, path: str, done: DataFrame) -> DataFrame:
    """(path, sha256) of files whose content isn't among done (sha256)."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
    return files.join(done.select("sha256"), "sha256", "left_anti")


def write_guarded(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV whose texts no spreadsheet takes for formulas; numbers stay as they are."""
    cells = [safe_cell(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*cells).write.mode("overwrite").options(header=True, sep=sep, lineSep="\r\n").csv(path)
