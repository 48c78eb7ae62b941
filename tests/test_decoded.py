"""Documents that went through files of several encodings are as their SQL reads them."""

import hashlib

import pytest

from matlink.plans.overview import decoded_files

TEXTS = ["plain", "", " ", "\n", None, "a\r\nb", "a\rb", "\x0bx\x0b", " x ", "　x", "x ", "\u0085x", "\x01x\x02", "x\x00y", "  x \n", 'a\\"b', '"', "…x…", "Ã©", "« x »", "\x81é", "a|b,c;d\te", "-", "Die Größe der Schraube ist für die Prüfung wichtig, après été à la fenêtre"]


@pytest.mark.parametrize("lang", ["en", "de", "es", None, "", " x ", "-"])
def test_blank_and_odd_texts(spark, tmp_path, lang):
    """Only the white space that SQL's \\s knows is trimmed, and a blank text isn't a missing one."""
    rows = [(i, lang, t) for i, t in enumerate(TEXTS)] + [(None, lang, None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    want = {(i, lang, None if t is None else hashlib.sha256(t.strip(" \t\n\f\r").encode()).hexdigest()) for i, lang, t in rows}
    got = decoded_files(spark, f"file://{tmp_path}").collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want
