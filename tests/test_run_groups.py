"""A run's groups by kinds are those that following each pair gives, in every mode and at every cap."""

import pytest
from pyspark.sql import functions as F

from matlink.operators.cluster import blocked_witness, constrained_clusters
from matlink.operators.decide import spec_classes, vetoes
from matlink.plans import harmonise

TEXTS = ["GATE VALVE 4IN CL150 A216 WCB FLGD RF", "GATE VALVE 4IN A216 WCB FLGD RF", "GATE VALVE 4IN CL300 A216 WCB FLGD RF", "PIPE 6IN SCH 40 A106 B", "PIPE SMLS 6IN SCH 40 A106 B", "PIPE SMLS SCH 40 A106 B", "SOMETHING ELSE"]


def records_of(spark, rows):
    table = spark.createDataFrame(rows, "id long, org string, short_text string, maker string, mpn string")
    return table.withColumns({"long_text": F.lit(None).cast("string"), "critical": F.lit(None).cast("boolean")})


@pytest.mark.parametrize("mode,caps", [("CROSS", {}), ("WITHIN", {}), ("BOTH", {"block_cap": 5, "lexical_k": 3, "size_cap": 4})])
def test_groups(spark, mode, caps):
    rows = [(i, f"O{i * 5 % 3}", TEXTS[i % len(TEXTS)], "ACME" if i % 4 == 0 else None, f"P{i % 8}") for i in range(35)]
    made = harmonise.run(records_of(spark, rows), mode, **caps)
    edges = made.pairs.where("verdict in ('IDENTICAL', 'EQUIVALENT')").select(F.col("id_a").alias("i"), F.col("id_b").alias("j"), F.col("confidence").alias("score"))
    classes = spec_classes(made.specs)
    members, blocked = constrained_clusters(edges, vetoes(made.specs), caps.get("size_cap"), classes)
    want = sorted(members.select("id", "cluster").collect())
    assert want and sorted(made.members.select("id", "cluster").collect()) == want
    told = blocked_witness(blocked, members, vetoes(made.specs), classes)
    assert sorted(made.blocked.collect(), key=str) == sorted(told.select(*made.blocked.columns).collect(), key=str)


def test_large_groups_are_whole(spark):
    """Blocks and groups are not cut: 260 equal items of two orgs are one group, as the SQL of the query has it."""
    rows = [(i, f"O{i % 2}", "PIPE SMLS 2IN SCH 40 A106 B", None, None) for i in range(260)]
    got = harmonise.run(records_of(spark, rows)).members.collect()
    assert sorted((r.id, r.cluster) for r in got) == [(i, 0) for i in range(260)]
