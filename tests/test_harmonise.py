"""A whole run: which channels find its pairs."""

from pyspark.sql import functions as F

from matlink.plans import harmonise


def records_of(spark):
    rows = [(i, str(i % 2), f"PIPE SMLS {n}IN SCH 40 A106 B", None, None) for i, n in enumerate([2, 2, 4, 4, 6, 6])]
    rows += [(10, "0", "SOMETHING ELSE", "ACME", "P1"), (11, "1", "ANOTHER THING", " acme", "p1 ")]
    return spark.createDataFrame(rows, "id long, org string, short_text string, maker string, mpn string").withColumns({"long_text": F.lit(None).cast("string"), "critical": F.lit(None).cast("boolean")})


def test_dense_channel(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.9, 0.1]), (5, [0.0, 1.0])], "id long, vector array<double>")
    found = {(r.id_a, r.id_b): r.channels for r in harmonise.run(records_of(spark), vectors=vectors, dense_k=2).pairs.collect()}
    # of the two nearest, those of the other org: 3 for 0 and 2, 0 and 2 for 3, 2 for 5
    assert {p for p, c in found.items() if c & 4} == {(0, 3), (2, 3), (2, 5)}
    assert found[2, 3] == 5 and found[10, 11] == 8


def test_registered_run(spark, data, monkeypatch):
    seen = {}
    true_run = harmonise.run

    def run(records, **more):
        seen.update(more, records=records)
        return true_run(records, **more)

    monkeypatch.setattr(harmonise, "run", run)
    harmonise.harmonise_run(spark, data)
    assert seen.pop("records").where("maker is not null and mpn is not null").count() > 0
    assert not seen  # every number is the operator's own
