"""Exact token totals for every context limit from one histogram of encoded lengths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import map_arrow, materialize
from .encoding import encoder, rebatched

#: Lengths are summed in blocks of so many, so that no task gets the whole histogram.
BLOCK = 4096


def length_histogram(docs: DataFrame, vocabulary: str, blanks: bool = True) -> DataFrame:
    """(length, n_docs): documents by encoded length of the whole text; null and empty texts have length 0.

    Each task sends one row for each length that it saw.  Repeated rows count each; an empty table gives no rows; other
    columns don't matter.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(vocabulary, blanks), Counter()
        for b in rebatched(batches):
            seen.update(len(ids) // 4 for ids in enc.encode_all(b.column(0)))
        if seen:
            yield pa.record_batch([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["length", "n"])

    return map_arrow(docs.select("text"), count, "length long, n long").groupBy("length").agg(F.sum("n").alias("n_docs"))


def length_totals(histogram: DataFrame) -> DataFrame:
    """One row for each length that occurs, taken as a context limit.

    Columns: length, n_docs, docs_longer, tokens (of documents of at most that length), tokens_truncated (of all
    documents, each cut at the limit), docs_cut_share, quantile (share of documents of at most that length).
    Suffix sums run inside blocks of lengths; a small table of block sums joins them.  An empty table gives no rows.
    """
    histogram = materialize(histogram, "lengths")  # texts are encoded once
    h = histogram.select("length", "n_docs", F.floor(F.col("length") / BLOCK).cast("long").alias("block"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bn"), F.sum(F.col("n_docs") * F.col("length")).alias("bt"))
    later = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    ends = blocks.select(
        "block",
        F.coalesce(F.sum("bn").over(later), F.lit(0)).alias("later_n"),
        F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("later_t"),
        F.sum("bn").over(everything).alias("all_n"),
        F.sum("bt").over(everything).alias("all_t"),
    )
    after = W.partitionBy("block").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)

    def suffix(value: Column, rest: str) -> Column:
        return F.coalesce(F.sum(value).over(after), F.lit(0)) + F.col(rest)

    s = h.join(ends, "block").select("*", suffix(F.col("n_docs"), "later_n").alias("docs_longer"), suffix(F.col("n_docs") * F.col("length"), "later_t").alias("t"))
    return s.select(
        "length",
        "n_docs",
        "docs_longer",
        (F.col("all_t") - F.col("t")).alias("tokens"),
        (F.col("all_t") - F.col("t") + F.col("docs_longer") * F.col("length")).alias("tokens_truncated"),
        (F.col("docs_longer") / F.col("all_n")).alias("docs_cut_share"),
        ((F.col("all_n") - F.col("docs_longer")) / F.col("all_n")).alias("quantile"),
    )


def _long(one: DataFrame, columns: dict[str, list]) -> DataFrame:
    """One row of many columns to one row for each of the asked values."""
    arrays = [F.array(*values).alias(name) for name, values in columns.items()]
    return one.select(F.explode(F.arrays_zip(*arrays)).alias("x")).select(*[F.col(f"x.{name}").alias(name) for name in columns])


def truncated_total(totals: DataFrame, limits: list[int]) -> DataFrame:
    """(context, tokens, docs_longer) for stated limits that need not occur as a length."""
    at = [F.max_by(F.struct("tokens", "docs_longer"), F.when(F.col("length") <= c, F.col("length"))).alias(f"c{k}") for k, c in enumerate(limits)]
    one = totals.agg(F.coalesce(F.max(F.col("n_docs") + F.col("docs_longer")), F.lit(0)).alias("all_n"), *at)
    longer = [F.coalesce(F.col(f"c{k}.docs_longer"), F.col("all_n")) for k in range(len(limits))]
    tokens = [F.coalesce(F.col(f"c{k}.tokens"), F.lit(0)) + longer[k] * c for k, c in enumerate(limits)]
    return _long(one, {"context": [F.lit(int(c)).cast("long") for c in limits], "tokens": tokens, "docs_longer": longer})


def length_quantiles(totals: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least that share of documents does not exceed."""
    one = totals.agg(*[F.min(F.when(F.col("quantile") >= q, F.col("length"))).alias(f"q{k}") for k, q in enumerate(shares)])
    return _long(one, {"share": [F.lit(float(q)) for q in shares], "length": [F.col(f"q{k}") for k in range(len(shares))]})
