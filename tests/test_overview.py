"""Overviews, queues, notices and purchase files on small tables, and the shape of their plans."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from matlink.operators import overview, procurement


def test_subqueries_become_joins(spark):
    records = spark.createDataFrame([(1, "A", 10.0), (2, "A", None), (3, "B", None), (4, None, 1.0)], "id long, org string, annual_value double")
    batches = spark.createDataFrame([(1, "A", 5, 70), (2, "A", 9, None), (3, "A", 5, 60), (4, "C", 1, 1)], "batch long, org string, created long, health int")
    members = spark.createDataFrame([(1, "A"), (1, "A"), (2, "A")], "id long, org string")
    out = overview.organisations(records, batches, members)
    assert sorted(tuple(r) for r in out.collect()) == [("A", 2, 10.0, 60, 2), ("B", 1, 0.0, None, 0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_groups_and_relations(spark):
    clusters = spark.createDataFrame([("x", 1), ("y", 2)], "cluster string, note int")
    members = spark.createDataFrame([("x", "B", "b", 1.0), ("x", "A", "a", None), ("x", "A", "c", 2.0)], "cluster string, org string, text string, annual_value double")
    out = overview.groups(clusters, members)
    assert sorted(tuple(r) for r in out.collect()) == [("x", 1, 3, "A,B", "a", 3.0), ("y", 2, 0, "", None, 0.0)] or sorted(tuple(r) for r in out.collect())[1][2] == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    pairs = spark.createDataFrame([(1, 2, "IDENTICAL"), (1, 3, "IDENTICAL"), (4, 5, "IDENTICAL"), (5, 6, "EQUIVALENT"), (3, 4, "NOT_EQUIVALENT")], "rec_a long, rec_b long, verdict string")
    of = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 4), ("y", 5), ("y", 6), ("z", 7)], "cluster string, id long")
    assert {tuple(r) for r in overview.relations(pairs, of).collect()} == {("x", "IDENTICAL"), ("y", "EQUIVALENT"), ("z", "EQUIVALENT")}


def test_queue(spark):
    tasks = spark.createDataFrame([(1, "MADE", 7, "V", True), (2, "MADE", None, "V", False), (3, "MADE", 8, "P", True), (4, "OPEN", 7, "V", None)], "id long, state string, made_by int, category string, critical boolean")
    ids = lambda **of: sorted(r.id for r in tasks.where(overview.in_queue(7, **of)).collect())
    assert ids() == [1, 2, 3, 4] and ids(stage="to_check") == [2, 3] and ids(stage="to_propose") == [4] and ids(stage="to_check", category="P", critical=True) == [3] and ids(critical=False) == [2]
    with pytest.raises(ValueError, match="unknown stage"):
        overview.in_queue(7, "nowhere")


def test_notice_scope(spark):
    cases = [("MAKER", "A", None, None, "A", None), ("CHECKER", "A", "A", True, "A", None), ("MAKER", "A", "B", True, None, "FORBIDDEN"), ("MAKER", None, None, None, None, "FORBIDDEN"), ("ADMIN", None, "B", True, "B", None), ("ADMIN", "A", "", None, None, "NO_ORG"), ("INTEGRATOR", None, "Z", None, None, "NOT_FOUND"), ("MAKER", "A", "", None, "A", None)]
    table = spark.createDataFrame([c[:4] for c in cases], "role string, own string, asked string, known boolean")
    got = table.select(overview.notice_scope(*(F.col(c) for c in table.columns)).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [c[4:] for c in cases]


HEADERS = "Material Code;BEDAT;MENGE;Net_PR;price;LIFNR;Größe"
LINES = [
    "L1;2024-01-31;5;1;10.5;V;x", " L1 ;31/01/2024;5 EA;9;INR 10.50; V ;x", "L2;2024/02/01;7;1;;;x", "L9;2024-02-01;7;1;1;V;x", ";2024-02-01;7;1;1;V;x", "L2;someday;7;1;1;V;x", "L2;2024-02-01;-7;1;1;V;x",
    "L1;2024-01-31;5;1;10.5;W;x", "L2;2024-02-01;7;1;1;V", "L2;2024-02-01;7;1;1;V;x;more", "L3;2023-01-01;2;1;4;V;x",
]


@pytest.fixture
def rows(spark, tmp_path):
    path = tmp_path / uuid.uuid4().hex
    path.mkdir()
    (path / "a.csv").write_text("\r\n".join([HEADERS, *LINES]) + "\r\n", encoding="cp1252")
    return procurement.read_purchases(spark, f"file://{path}")


def test_states_of_lines(spark, rows):
    records = spark.createDataFrame([(1, "L1"), (2, "L2"), (3, "L3"), (30, "L3"), (4, None)], "record long, legacy_code string")
    known = spark.createDataFrame([(30, dt.date(2023, 1, 1), 2.0, 4.0, None)], "record long, po_date date, qty double, unit_price double, vendor_hash string")
    done = procurement.ingest(rows, records, salt="s")
    assert {r.state: r.rows for r in done.counts.collect()} == {"LINE": 4, "UNMATCHED": 2, "INVALID": 2, "DUPLICATE": 1, "CORRUPT": 2}
    lines = {(r.record, str(r.po_date), float(r.qty), r.unit_price and float(r.unit_price), r.currency) for r in done.lines.collect()}
    assert lines == {(1, "2024-01-31", 5.0, 10.5, "INR"), (2, "2024-02-01", 7.0, None, "INR"), (30, "2023-01-01", 2.0, 4.0, "INR")}
    hashed = done.lines.where("record = 30").select("record", "po_date", "qty", "unit_price", "vendor_hash")
    again = procurement.ingest(rows, records, hashed, salt="s")
    assert {r.state: r.rows for r in again.counts.collect()}["DUPLICATE"] == 2
    assert {r.state: r.rows for r in procurement.ingest(rows, records, known.withColumns({"qty": F.col("qty").cast("decimal(38,6)"), "unit_price": F.col("unit_price").cast("decimal(38,6)")}), salt="s").counts.collect()}["DUPLICATE"] == 1
    assert {r.rows for r in procurement.ingest(rows.limit(0), records).counts.collect()} == {0}


def test_annual_figures_fill_gaps_only(spark, rows):
    records = spark.createDataFrame([(1, "L1"), (2, "L2"), (30, "L3")], "record long, legacy_code string")
    lines = procurement.ingest(rows, records, salt="s").lines
    own = spark.createDataFrame([(1, None, None), (2, 3.0, None), (30, None, 8.0), (5, None, None)], "record long, annual_qty double, annual_value double")
    got = {r.record: (r.annual_qty and float(r.annual_qty), None if r.annual_value is None else float(r.annual_value)) for r in procurement.fill_annual(own, lines).collect()}
    assert got == {1: (10.0, 105.0), 2: (3.0, 0.0), 30: (None, 8.0), 5: (None, None)}


def test_headers():
    assert procurement.mapped_headers(["MARA-MATNR", "Matnr", "code", "Date", "QTY", "qty"]) == {"legacy_code": "Matnr", "po_date": "Date", "qty": "QTY"}
    with pytest.raises(ValueError, match="missing columns: po_date, qty"):
        procurement.mapped_headers(["code"])
