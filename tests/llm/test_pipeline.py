"""The pipeline against its stages' brute-force rules on the smallest tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from barweave.llm import decontamination
from test_text_operators import brute_components, brute_hits, py_metrics

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        steps.append(docs)
        assert docs.columns == columns or stage is corpus_pipeline.pack
    start = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r.doc_id: r.text for r in steps[0].collect()}
    for i, t in start.items():
        n, _, sym, _, rep = py_metrics(t)
        if n < 20 or 100 * rep > 30 * n or 100 * sym > 30 * n:
            assert i not in kept
    near = {r.doc_id: r.text for r in steps[1].collect()}
    assert set(near) == {c for _, c in brute_components(list(kept.items()), 80, 5).values()}
    items = [(r.item_id, decontamination.alnum_words(r.text.encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in steps[2].collect()}
    assert clean == {i for i, t in near.items() if not brute_hits(decontamination.alnum_words(t.encode()), items)[0]}
    assert {r.doc_id for r in steps[3].collect()} == clean
    assert {r.doc_id for r in steps[4].collect()} == clean
    run = corpus_pipeline.run(spark, SF)
    assert run.agg(F.sum("length")).first()[0] == steps[4].agg(F.sum("length")).first()[0]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
