"""Canonical JSON: sorted keys, no spaces, times in UTC with microseconds, as one expression of any value.

The builder walks a column's schema (structs, maps, arrays, atoms), so a nested value becomes text
without a Python function. Texts are as UTF-8 says, with only the escapes JSON asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: escapes of control characters that have a letter ----
_LETTERS = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}


def python_number(value: Column) -> Column:
    """A double as Python writes it: 1.0, 0.001, 1e-05, 1e+16, nan."""
    text = value.cast("string")
    mantissa, power = F.regexp_extract(text, r"^(-?[0-9.]+)E", 1), F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"[-.]", ""), r"0+$", "")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    whole = F.concat(F.rpad(digits, power + 1, "0"), F.lit("."), F.when(F.length(digits) > power + 1, F.substring(digits, power + 2, F.length(digits))).otherwise("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    point = F.when(F.length(digits) > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(digits)
    size = F.abs(power).cast("string")
    science = F.concat(point, F.when(power < 0, "e-").otherwise("e+"), F.lpad(size, F.greatest(F.lit(2), F.length(size)), F.lit("0")))
    written = F.when(power.isNull(), text).when(power.between(-4, -1), F.concat(sign, small)).when(power.between(0, 15), F.concat(sign, whole)).otherwise(F.concat(sign, science))
    return F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").otherwise(written)


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rare = out
    for code in range(32):
        rare = F.replace(rare, F.lit(chr(code)), F.lit("\\" + _LETTERS.get(code, f"u{code:04x}")))
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1f]"), rare).otherwise(out), F.lit('"'))


def _time(value: Column) -> Column:
    """ISO text in UTC; timestamps without a zone are in UTC already."""
    return quoted(F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")))


def _text(value: Column, kind: T.DataType, zone: str) -> Column:
    if isinstance(kind, T.StructType):
        parts = [F.concat(quoted(F.lit(f.name)), F.lit(":"), _value(value[f.name], f.dataType, zone)) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: _value(x, kind.elementType, zone)), ","), F.lit("]"))
    if isinstance(kind, T.MapType):
        key = lambda k: k if isinstance(kind.keyType, T.StringType) else _plain(k, kind.keyType, zone)
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(key(e["key"]).alias("k"), _value(e["value"], kind.valueType, zone).alias("v"))))
        return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))
    if isinstance(kind, T.TimestampType):
        return _time(F.to_utc_timestamp(value, zone))
    if isinstance(kind, T.TimestampNTZType):
        return _time(value)
    if isinstance(kind, T.FloatType | T.DoubleType):
        written = python_number(value.cast("double"))
        return F.when(F.isnan(value), "NaN").otherwise(F.replace(written, F.lit("inf"), F.lit("Infinity")))
    if isinstance(kind, T.IntegralType | T.BooleanType):
        return value.cast("string")
    if isinstance(kind, T.NullType):
        return F.lit(None).cast("string")
    if isinstance(kind, T.BinaryType):
        raise ValueError("bytes have no canonical JSON")
    return quoted(value.cast("string"))  # texts, dates, decimals and what else is written as text


def _plain(value: Column, kind: T.DataType, zone: str) -> Column:
    """A map's key that is no text."""
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"keys of type {kind.simpleString()} have no canonical JSON")
    return value.cast("string")


def _value(value: Column, kind: T.DataType, zone: str) -> Column:
    return F.coalesce(F.when(value.isNotNull(), _text(value, kind, zone)), F.lit("null"))


def canonical_json(rows: DataFrame, *columns: str) -> Column:
    """The canonical JSON object of these columns of rows, or of all.

    Keys ascend by code point, nulls stay as null, decimals and dates are texts. Map keys are texts or whole
    numbers. The order of entries of a map and of fields of a struct makes no difference.
    """
    zone = rows.sparkSession.conf.get("spark.sql.session.timeZone")
    kind = T.StructType([rows.schema[c] for c in columns or rows.columns])
    parts = [F.concat(quoted(F.lit(f.name)), F.lit(":"), _value(F.col(f"`{f.name}`"), f.dataType, zone)) for f in sorted(kind.fields, key=lambda f: f.name)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
