"""Tokens of the n-gram join beyond what is broadcast: few rows are shuffled again, and links stay."""

from collections import Counter

from barweave.llm import _common, ngram_join

SF = "/root/testdata/sf0.001"


def test_rows_of_other_tokens_are_not_shuffled(spark, monkeypatch):
    rows = spark.range(40_000).selectExpr("xxhash64(id) AS token", "id AS node")
    tokens = spark.range(0, 40_000, 100).selectExpr("xxhash64(id) AS token").union(spark.range(50_000, 50_100).selectExpr("xxhash64(id) AS token"))
    assert ngram_join.sifted(rows, tokens) is rows
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 10)
    found = [tuple(x) for x in ngram_join.sifted(rows, tokens).collect()]
    assert len(found) == len(set(found)) and set(range(0, 40_000, 100)) <= {node for _, node in found}
    assert len(found) < 440
    assert ngram_join.sifted(rows, tokens.limit(0)).columns == rows.columns


def test_links_without_broadcasts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = Counter(tuple(x) for x in ngram_join.jaccard_components(docs, 80, 5).collect())
    for module in (_common, ngram_join):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert Counter(tuple(x) for x in ngram_join.jaccard_components(docs, 80, 5).collect()) == before
