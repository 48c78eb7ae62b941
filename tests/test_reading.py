"""The classifier behind the rules, and answers that have to be proven."""

import pytest
from pyspark.sql import functions as F

from matlink.operators.classify import train, word_grams
from matlink.operators.extract import specs
from matlink.operators.reader import coerced, missing_core, verified
from matlink.plans.items import QUERIES


def test_grams(spark):
    got = spark.createDataFrame([("Ab  c",)], "t string").select(word_grams(F.col("t"))).first()[0]
    assert got == [" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c ", " c "]


def test_items_without_their_nouns(spark, data):
    """Held-out: texts that lost their nouns are told by what is left."""
    rows = QUERIES["classified_items"](spark, data).toPandas()
    from matlink.plans.views import item_texts

    truth = item_texts(spark, data).select("id", F.col("category").alias("truth")).toPandas()
    both = rows.merge(truth, on="id")
    told = both[both["class_source"] == "ML"]
    assert len(told) >= len(both) / 4 and (told["category"] == told["truth"]).mean() > 0.95
    ruled = both[both["class_source"] == "RULE"]
    assert (ruled["category"] == ruled["truth"]).all()


def test_unsure_texts_stay_without_category(spark):
    known = spark.createDataFrame([(f"GATE {i}IN CL150", "VALVE") for i in range(20)] + [(f"HEX M{i} X 20", "FASTENER") for i in range(20)] + [(f"OFFICE PAPER BOX {i}", "NONE") for i in range(20)] + [("", "NONE")] * 20, "norm_text string, category string")
    texts = spark.createDataFrame([(1, "GATE 4IN CL150"), (2, "OFFICE PAPER BOX A4"), (3, "VALVE GATE 4IN CL150"), (4, None), (5, "")], "id long, norm_text string")
    got = {r.id: (r.category, r.class_source) for r in specs(texts, model=train(known), threshold=0.8).collect()}
    assert got == {1: ("VALVE", "ML"), 2: (None, "NONE"), 3: ("VALVE", "RULE"), 4: (None, "NONE"), 5: (None, "NONE")}
    assert "class_source" not in specs(texts).columns


ANSWERS = [
    ("valve_type", " gate ", "Gate  valve", "GATE"), ("valve_type", "GATE", "globe", None), ("valve_type", "PLUG", "gate", None), ("valve_type", "BALL", "GATE", None), ("pressure_class", "150.9", "CL150", "150"), ("pressure_class", "many", "CL150", None),
    ("pressure_class", "300", "CL150", None), ("size_dn", "100", "4 in", "100"), ("size_dn", "150", "4 in", None), ("valve_type", None, "GATE", None), ("valve_type", "GATE", None, None), ("valve_type", "GATE", "  ", None), ("trim", "13cr", "trim 13CR", "13CR"),
]


def test_answers(spark):
    rows = spark.createDataFrame([(i, "Gate  valve 4 in CL150 WCB\ntrim 13cr", "VALVE") for i in range(len(ANSWERS))] + [(99, "gate", None)], "id long, text string, category string")
    answers = spark.createDataFrame([(i, *a[:3]) for i, a in enumerate(ANSWERS)] + [(99, "valve_type", "GATE", "gate"), (1000, "valve_type", "GATE", "gate")], "id long, attr string, value string, span string")
    got = {r.id: r.value for r in verified(answers, rows).collect()}
    assert got == {i: a[3] for i, a in enumerate(ANSWERS) if a[3] is not None}


@pytest.mark.parametrize("attr,value,want", [("poles", "4.7", "4"), ("poles", "-0.5", "0"), ("poles", "inf", None), ("power_kw", "5.5", "5.5"), ("power_kw", "x", None), ("schedule", " 40s ", "40S"), ("schedule", "", None), ("face", "rf", "RF"), ("face", "zz", None)])
def test_coerced(spark, attr, value, want):
    got = spark.createDataFrame([(attr, value)], "a string, v string").select(coerced(F.col("a"), F.col("v"))).first()[0]
    assert got == want or (want == "0" and got in ("0", "-0"))


def test_missing_core(spark):
    table = spark.createDataFrame([("VALVE", {"a": "1"}), (None, {}), ("VALVE", None)], "c string, attrs map<string,string>")
    core = F.array(F.lit("a"), F.lit("b"))
    assert [r[0] for r in table.select(missing_core(F.col("c"), F.col("attrs"), core)).collect()] == [["b"], None, ["a", "b"]]
