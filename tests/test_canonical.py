"""Canonical JSON against Python's json module."""

import datetime as dt
import decimal
import json

import pytest
from pyspark.sql import Row

from matlink.functions.canonical import canonical_json

SCHEMA = "id long, b boolean, x double, f float, s string, d date, t timestamp, n timestamp_ntz, m map<string,array<struct<z:int,a:string>>>, k map<int,double>, deep struct<`é`:string,a:struct<q:array<array<long>>>,Z:int>, money decimal(12,2), nothing void"
UTC = dt.UTC


def rows():
    t, n = dt.datetime(2024, 2, 29, 23, 59, 59, 7, UTC), dt.datetime(1999, 1, 1, 0, 0, 0)
    return [
        (1, True, 1.0, 0.5, 'a "quoted" \\ back/slash', dt.date(2024, 1, 2), t, n, {"z": [(1, "x"), None], "a": [], "é": None, "Z": [(None, None)]}, {10: 1e-7, 9: None, 1: 1e16}, ("ü", ([[1, 2], [], None],), 3), decimal.Decimal("5.10"), None),
        (2, None, 1e-5, None, "tab\tline\nnul\x00 bell\x07 é 😀   \x7f", None, None, None, None, {}, None, None, None),
        (3, False, 123456789.125, 1.5, "", dt.date(1, 1, 1), t, n, {}, None, (None, None, None), decimal.Decimal("-0.01"), None),
        (4, False, -2.5e-300, -0.0, "\r\b\f\x1f", None, None, None, {"": [(2, "")]}, {0: 0.1}, ("", (None,), 0), None, None),
    ]


def plain(r):
    def fix(v):
        if isinstance(v, dt.datetime):
            return v.replace(tzinfo=v.tzinfo or UTC).astimezone(UTC).isoformat(timespec="microseconds")
        if isinstance(v, dt.date | decimal.Decimal):
            return str(v)
        if hasattr(v, "asDict"):
            return {k: fix(x) for k, x in v.asDict().items()}
        if isinstance(v, dict):
            return {str(k): fix(x) for k, x in v.items()}
        return [fix(x) for x in v] if isinstance(v, list) else v

    return json.dumps(fix(r), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_like_python(spark):
    table = spark.createDataFrame(rows(), SCHEMA)
    got = table.select("id", canonical_json(table).alias("j")).collect()
    given = {r.id: r for r in table.collect()}
    for r in got:
        own = given[r.id].asDict()
        if own["t"] is not None:
            own["t"] = dt.datetime(2024, 2, 29, 23, 59, 59, 7, UTC)
        assert r.j == plain(Row(**own))


def test_zone_and_order_make_no_difference(spark):
    table = spark.sql("SELECT map('b', 1, 'a', 2) AS m, named_struct('y', 1, 'x', 2) AS s, timestamp'2024-07-01 12:00:00+02:00' AS t")
    other = spark.sql("SELECT timestamp'2024-07-01 10:00:00Z' AS t, named_struct('x', 2, 'y', 1) AS s, map('a', 2, 'b', 1) AS m")
    want = '{"m":{"a":2,"b":1},"s":{"x":2,"y":1},"t":"2024-07-01T10:00:00.000000+00:00"}'
    assert table.select(canonical_json(table)).first()[0] == other.select(canonical_json(other)).first()[0] == want
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        assert table.select(canonical_json(table)).first()[0] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_refused(spark):
    for sql in ("SELECT X'00' AS b", "SELECT map(1.5D, 2) AS m"):
        table = spark.sql(sql)
        with pytest.raises(ValueError, match="canonical"):
            canonical_json(table)
