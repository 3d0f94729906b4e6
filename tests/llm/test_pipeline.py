"""The pipeline on a small table: each stage's decisions take effect."""

import corpus_pipeline
from keyline.llm import mixing, pii, quality


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf)
        if name != "packing":
            assert docs.columns == before.columns
            docs = spark.createDataFrame(docs.collect(), before.schema)
        by[name] = docs
    ids = {k: sorted(r["doc_id"] for r in v.collect()) for k, v in by.items()}
    judged = quality.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids["quality"] == sorted(r["doc_id"] for r in judged.where("_kl_kept").collect())
    assert set(ids["near_dedup"]) < set(ids["quality"]) and ids["pii"] == ids["near_dedup"]
    text = {r["doc_id"]: r["text"] for r in by["near_dedup"].collect()}
    assert all(r["text"] == pii.pseudonymised(text[r["doc_id"]])[0] for r in by["pii"].collect())
    assert ids["mixing"] == sorted(r["doc_id"] for r in mixing.mixed(by["pii"]).collect()) and set(ids["mixing"]) == set(ids["packing"])


def test_run_agrees(spark):
    sf = "/root/testdata/sf0.001"
    key = lambda r: tuple(r)
    cut = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(key, corpus_pipeline.run(spark, sf).select(*cut).collect())) == sorted(map(key, corpus_pipeline.run(spark, sf).select(*cut).collect()))
