"""Encodings told from bytes, and delimited files of several kinds read together."""

import uuid

import pytest
from pyspark.sql import functions as F

from matlink.functions.text import lenient_date
from matlink.sources.encoding import characters, decoded, detect, encoded, fits
from matlink.sources.files import _trimmed, header, read_delimited

TEXTS = {
    "en": "The valve is closed and the pump runs at full speed",
    "fr": "Le débit de la vanne à été mesuré; où est le câble? Très près du château, après la fenêtre, français",
    "de": "Die Größe der Schraube ist für die Prüfung wichtig, Öl läuft über das Gehäuse, weiß",
    "pl": "Zażółć gęślą jaźń, śruba łożyska, część zamienna, źródło, ćwierć",
    "cs": "Příliš žluťoučký kůň úpěl ďábelské ódy, těsnění, čerpadlo, šroub",
    "ru": "Клапан закрыт, насос работает на полной скорости, Труба стальная",
    "el": "Η βαλβίδα είναι κλειστή και η αντλία λειτουργεί",
}
CASES = [("en", "utf-8"), ("fr", "utf-8"), ("fr", "cp1252"), ("de", "cp1252"), ("pl", "cp1250"), ("cs", "cp1250"), ("ru", "cp1251"), ("ru", "koi8-r"), ("el", "cp1253"), ("ru", "utf-16"), ("de", "utf-16")]


@pytest.mark.parametrize("lang,encoding", CASES)
def test_told(spark, tmp_path, lang, encoding):
    file = tmp_path / "f.csv"
    file.write_bytes("\r\n".join(["\r\n", "code;text", *(f"L{i};{TEXTS[lang]}" for i in range(20))]).encode(encoding))
    row = detect(spark, f"file://{file}").first()
    assert row.encoding == encoding and (encoding == "utf-16" or not row.open_quotes)
    rows = read_delimited(spark, f"file://{file}").collect()
    assert {tuple(r) for r in rows} == {(f"L{i}", TEXTS[lang].split(";")[0]) for i in range(20)}


def test_files_together(spark, tmp_path):
    path = tmp_path / uuid.uuid4().hex
    path.mkdir()
    (path / "a.csv").write_text("﻿Code,Text\nA1, \"two\nlines\" \nA2,\"x\ny\"\n,\n , \t\n", encoding="utf-8")
    (path / "b.csv").write_text("Code;Größe;\nB1;  10 m\xa0;z\nB2;5\n", encoding="cp1252")
    (path / "c.csv").write_text("Code\tText\nC1\t“quoted” € – ™\n", encoding="cp1252")
    (path / "d.csv").write_text("", encoding="utf-8")
    rows = read_delimited(spark, f"file://{path}")
    assert set(rows.columns) == {"Code", "Text", "Größe", "column 3"}
    got = {r["Code"]: (r["Text"], r["Größe"], r["column 3"]) for r in rows.collect()}
    assert got["A2"] == ("x\ny", None, None) and got["B1"] == (None, "10 m", "z") and got["B2"] == (None, "5", None) and got["C1"] == ("“quoted” € – ™", None, None)


def test_bytes_without_a_character(spark, tmp_path):
    file = tmp_path / "f.csv"
    file.write_bytes(f"code;text\nL1;\x81 {TEXTS['fr']}\n".encode("latin-1"))
    assert detect(spark, f"file://{file}").first().encoding == "latin-1"


def test_headers(spark, tmp_path):
    assert header("a;b;;c,d") == (";", ["a", "b", "column 3", "c,d"])
    with pytest.raises(ValueError, match="same name"):
        header("MARA-MATNR,mara matnr")
    file = tmp_path / "f.csv"
    file.write_text("\n\n")
    with pytest.raises(ValueError, match="no rows"):
        read_delimited(spark, f"file://{file}")


@pytest.mark.parametrize("encoding", ["cp1252", "cp1250", "cp1251", "koi8-r", "latin-1"])
def test_every_byte(spark, encoding):
    text = "".join(c for c in characters(encoding) if c is not None)
    table = spark.createDataFrame([(text, "☃")], "t string, s string")
    row = table.select(encoded(F.col("t"), encoding).alias("e"), decoded(encoded(F.col("t"), encoding), encoding).alias("d"), fits(F.col("t"), encoding).alias("f"), fits(F.col("s"), encoding).alias("n")).first()
    assert row.e.encode("latin-1") == text.encode(encoding) and row.d == text and row.f and not row.n


def test_dates_of_any_shape(spark):
    """A format is tried only on texts of its shape, and no text loses the date that trying all four would give it."""
    tried = lambda t: F.coalesce(*(F.try_to_timestamp(F.trim(t), F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd")))
    texts = ["2023-01-31", " 31-01-2023 ", "31/01/2023", "2023/01/31", "2023-02-30", "1/2/2023", "+12023-01-31", "-0001-01-31", "12023-01-31", "31-01-+12023", "2023-01-31x", "soon", "", "٢٠٢٣-٠١-٣١", "2023-01-31\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    date = lenient_date(F.col("t"))
    assert "RLIKE" in str(date).upper()
    for r in rows.select("t", date.cast("string").alias("got"), tried(F.col("t")).cast("string").alias("want")).collect():
        assert r.got == r.want, r.t


def test_white_space_of_cells(spark):
    cells = [f"{a}x{chr(c)}y{chr(c)}" for c in range(0x3100) for a in ("", chr(c)) if not 0xD800 <= c < 0xE000] + ["", " 　\t", None]
    rows = spark.createDataFrame([(c,) for c in cells], "c string")
    want = F.nullif(F.regexp_replace("c", r"(?U)^\s+|\s+$", ""), F.lit(""))
    assert rows.where(~_trimmed(F.col("c")).eqNullSafe(want)).count() == 0


def test_lines_across_batches(spark, tmp_path):
    """Marks of a file come from all of its lines, wherever a batch of them ends."""
    path = tmp_path / uuid.uuid4().hex
    path.mkdir()
    (path / "a.csv").write_bytes(b"code;text\n" + b"L;x\n" * 3000 + "L;\"é\n".encode("cp1252"))
    (path / "b.csv").write_bytes(b"code;text\n" + b"L;\"x\"\n" * 3000 + "L;é\n".encode())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.file[-5:]: (r.encoding, r.open_quotes, bytes(r.head)) for r in detect(spark, f"file://{path}").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got["a.csv"][:2] == ("cp1252", True) and got["b.csv"][:2] == ("utf-8", False)
    assert got["a.csv"][2].startswith(b"code;text\nL;x\n") and got["b.csv"][2].startswith(b"code;text\nL;\"x\"\n")
