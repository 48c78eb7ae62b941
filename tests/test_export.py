"""Exports byte by byte against Python's csv module, and read back."""

import csv
import io
import json
import uuid
from pathlib import Path

import pytest

from matlink.sources import export as E

SCHEMA = "cnmc string, cnmc_short_desc_40 string, category string, cpse string, legacy_code string, legacy_short_text string, relation string, uom string, uom_factor double, migration_action string, status string, note string"
NASTY = ["=1+1", "+x", "-5", "@cmd", "\ttab", "plain", 'say "hi"', "a,b;c", "two\nlines", "", None, "#hash", " é ", "'quoted"]
NUMBERS = [1.0, 0.1, 1e-5, 1.5e-7, 12345678.9, 1e16, 1.25e21, 0.001, 0.0, -2.5, None, 1e15, 123456789012345680.0, 100.0]


def rows():
    out = []
    for i in range(60):
        text, number = NASTY[i % len(NASTY)], NUMBERS[i % len(NUMBERS)]
        out.append((f"NMC-{i // 3:04}", text, "VALVE", "ABC"[i % 3], f"{'#' if i % 5 == 0 else ''}L{i:03}", text, "EQUIVALENT", "EA", number, ["RETAIN", "BLOCK_FOR_NEW_PROCUREMENT", "PHASE_OUT_WHEN_STOCK_ZERO", None][i % 4], "ACTIVE" if i % 7 else "RETIRED", "extra"))
    return out


def guarded(v):
    return "'" + v if isinstance(v, str) and v.startswith(("=", "+", "-", "@", "\t", "\r")) else v


def plain(kept, columns, sep, preamble):
    buf = io.StringIO()
    if preamble:
        buf.write(f"# {preamble}\n")
    w = csv.writer(buf, delimiter=sep, lineterminator="\r\n")
    w.writerow(columns)
    for r in kept:
        w.writerow(["" if v is None else guarded(v) for v in r])
    return "﻿" + buf.getvalue()


def expected(org, kind):
    kept = sorted((r for r in rows() if r[3] == org and r[10] == "ACTIVE"), key=lambda r: (r[0], r[4]))
    if kind == "csv":
        return [r[:11] for r in kept], E.CROSSWALK_COLUMNS, ","
    return [(r[4], r[0], r[1], r[7], r[8], E.SAP_STATUS.get(r[9] or "", ""), r[3]) for r in kept], E.SAP_COLUMNS, ";"


@pytest.mark.parametrize("kind", ["csv", "sap_csv"])
@pytest.mark.parametrize("preamble", [None, "SYNTHETIC, not real; data"])
def test_files(spark, tmp_path, kind, preamble):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    counts = E.write_export(spark.createDataFrame(rows(), SCHEMA).repartition(7), f"file://{path}", kind, preamble)
    assert {(r.org, r.rows) for r in counts.collect()} == {(o, len(expected(o, kind)[0])) for o in "ABC"}
    back = {}
    for r in E.read_export(spark, f"file://{path}", kind, preamble is not None).collect():
        back.setdefault(r.org, []).append(tuple(r)[:-1])
    for org in "ABC":
        (file,) = Path(path, f"_org={org}").glob("part-*")
        kept, columns, sep = expected(org, kind)
        got = file.read_bytes().decode()
        assert list(csv.reader(io.StringIO(got[len(f"﻿# {preamble}\n") if preamble else 1 :], newline=""), delimiter=sep)) == list(csv.reader(io.StringIO(plain(kept, columns, sep, None)[1:], newline=""), delimiter=sep))
        assert got.startswith("﻿" + (f"# {preamble}\n" if preamble else "") + sep.join(columns) + "\r\n")
        if kind == "csv":  # in the other a line may start with a #, which is quoted
            assert got == plain(kept, columns, sep, preamble)
        want = [tuple(None if v is None or v == "" else str(guarded(v)) for v in r) for r in kept]
        assert sorted(back[org], key=str) == sorted(want, key=str)


def test_an_org_of_many_rows_has_several_files(spark, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    E.write_export(spark.createDataFrame(rows(), SCHEMA), f"file://{path}", "csv", "note", file_rows=10)
    for org in "ABC":
        files = sorted(Path(path, f"_org={org}").glob("part-*"))
        kept, columns, sep = expected(org, "csv")
        got = [csv.reader(io.StringIO(f.read_bytes().decode().removeprefix("﻿# note\n"), newline="")) for f in files]
        parts = [list(g) for g in got]
        assert len(files) > 1 and all(p[0] == columns for p in parts)
        assert [r for p in parts for r in p[1:]] == list(csv.reader(io.StringIO(plain(kept, columns, sep, None), newline="")))[1:]
    assert E.read_export(spark, f"file://{path}", preamble=True).count() == sum(r[10] == "ACTIVE" for r in rows())


def test_json_and_nothing(spark, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    E.write_export(spark.createDataFrame(rows(), SCHEMA), f"file://{path}", "json")
    for org in "ABC":
        (file,) = Path(path, f"_org={org}").glob("part-*")
        assert [tuple(json.loads(x).values()) for x in file.read_text().splitlines()] == expected(org, "csv")[0]
    assert E.write_export(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none").count() == 0
    with pytest.raises(ValueError, match="unknown kind"):
        E.write_export(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/other", "xml")
