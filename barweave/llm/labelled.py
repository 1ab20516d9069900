"""Labelled rows for the classifiers: which may be learned from, and a bounded sample of those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import if_small, materialize


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id's text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int) -> DataFrame:
    """(doc_id, text, y) of at most about ``bound`` labelled documents where ``learn`` holds, picked by a hash of the
    doc_id.  Rows without a label or doc_id aren't learned from; of repeated labels the largest counts, of several texts
    under one doc_id the one with the smallest hash (null is smaller still)."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    own = own.agg(F.max(F.col(label).cast("int")).alias("y")).where(learn)
    every = max(1, -(-own.count() // bound))
    own = own.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(every)) == 0)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = texts.join(if_small(materialize(own, "labels")), "doc_id")
    return known.groupBy("doc_id", "y").agg(F.min_by(F.struct("text"), F.struct(F.sha2("text", 256))).alias("least")).select("doc_id", "least.text", "y")
