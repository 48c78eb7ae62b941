"""The pipeline's stages on the small tables, each held against its own input."""

import re

import corpus_pipeline as pipeline
from matlink.llm import ngram_join


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = docs
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    before, after = kept["language_id"]
    assert after.count() == before.where("text rlike '[a-zA-Z]'").count()
    before, after = kept["near_duplicates"]
    members, _ = ngram_join.jaccard_classes(before)
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in members.collect()}
    before, after = kept["substring_dedup"]
    old, new, seen = ({r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text) for r in d.collect()} for d in (before, after, after.limit(0)))
    windows = set()
    for i in sorted(old):
        gone = [False] * len(old[i])
        for j in range(len(old[i]) - 19):
            window = tuple(old[i][j : j + 20])
            if window in windows:
                gone[j : j + 20] = [True] * 20
            windows.add(window)
        seen[i] = [w for w, g in zip(old[i], gone, strict=True) if not g]
    assert new == seen
    before, after = kept["packing"]
    assert {r.doc_id for r in before.collect()} == {r.doc_id for r in after.collect()}


def test_empty_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, data) if docs.columns[0] == "doc_id" else docs
    assert docs.count() == 0
