"""Sharding by sampled splitters: records are range-partitioned on their key into shards of near equal bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import map_arrow, materialize

#: Size-weighted key samples drawn over the whole table; the bound of what the driver sorts.
SAMPLES = 20_000
#: Records in a range, on average, and the most ranges; a range is sorted by one task, which may spill.
RANGE_ROWS, RANGES = 1_000_000, 10_000


def record_sizes(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, size, text_crc32, key): UTF-8 bytes of the text plus 1 (null: 1), and a hash of the text to range over.

    Equal texts lie together in key order; ``doc_id`` orders them, so a large group of copies can be cut anywhere.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.xxhash64(text).alias("key"), *more)


def draw_splitters(records: DataFrame, ranges: int, seed: int = 7) -> np.ndarray:
    """Boundaries (key, doc_id) at the quantiles of a sample in which a record's chance grows with its size.

    The chance depends on a hash of the record, so a lost task draws the same records again.
    """
    total = records.agg(F.sum("size")).first()[0] or 0
    chance = F.col("size") * (SAMPLES / max(total, 1))
    u = F.pmod(F.xxhash64("key", "doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = records.where(u < chance).select("key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.greatest(chance, F.lit(1.0)).alias("weight")).collect()
    if not drawn:
        return np.zeros(0, [("key", "i8"), ("doc_id", "i8")])
    rows = np.array([(r[0], r[1]) for r in drawn], [("key", "i8"), ("doc_id", "i8")])
    order = np.argsort(rows, order=["key", "doc_id"])
    weight = np.cumsum(np.array([r[2] for r in drawn])[order])  # a record of over one step counts as often as steps it spans
    at = np.searchsorted(weight, weight[-1] * np.arange(1, ranges) / ranges)
    return np.unique(rows[order][at])


def assign_ranges(records: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Adds ``bucket``: how many splitters lie at or below (key, doc_id)."""
    keys, names = np.ascontiguousarray(splitters["key"]), np.ascontiguousarray(splitters["doc_id"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy(zero_copy_only=False)
            doc = b.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            for i in np.flatnonzero(hi > lo):
                lo[i] += np.searchsorted(names[lo[i] : hi[i]], doc[i], "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lo.astype(np.int32))], [*b.schema.names, "bucket"])

    return map_arrow(records, place, ", ".join(f"`{n}` {t}" for n, t in records.dtypes) + ", bucket int")


def assign_shards(records: DataFrame, shards: int) -> DataFrame:
    """Adds (shard, slot) to (doc_id, size, text_crc32, key[, row]): contiguous key ranges of near equal bytes, slots
    gapless.  A column ``row`` is carried along.

    Many more ranges than shards are drawn from the sample.  Their exact bytes place every range on the axis of all
    bytes; a range over a shard boundary is overfull for either side and is subdivided at that byte by a running sum
    inside the range.  So a shard differs from the mean by one record at most, whatever the sample was.  The driver
    gets one pair of numbers for each range.
    """
    ranges = max(16 * shards, min(RANGES, -(-records.count() // RANGE_ROWS)))
    placed = materialize(assign_ranges(records, draw_splitters(records, ranges)), "ranges")
    sums = {r[0]: (r[1], r[2]) for r in placed.groupBy("bucket").agg(F.sum("size"), F.count("*")).collect()}
    total, first, at, n = sum(x for x, _ in sums.values()), np.zeros(ranges + 1, np.int64), 0, 0
    rows = np.zeros(ranges + 1, np.int64)
    for k in range(ranges + 1):
        first[k], rows[k] = at, n
        size, count = sums.get(k, (0, 0))
        at, n = at + size, n + count
    order = W.partitionBy("bucket").orderBy("key", F.asc_nulls_first("doc_id"), "size", "text_crc32")
    ranked = placed.select("*", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.row_number().over(order).alias("nth"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("bucket").to_numpy(zero_copy_only=False)
            size = b.column("size").to_numpy(zero_copy_only=False)
            middle = 2 * (first[k] + b.column("upto").to_numpy(zero_copy_only=False)) - size
            shard = np.array([int(m) * shards // (2 * total) for m in middle], np.int32)
            rank = rows[k] + b.column("nth").to_numpy(zero_copy_only=False) - 1
            yield pa.record_batch([*[b.column(n) for n in names], pa.array(shard, pa.int32()), pa.array(rank, pa.int64())], [*names, "shard", "rank"])

    names = [n for n in records.columns if n != "key"]
    cuts = map_arrow(ranked, cut, ", ".join(f"`{n}` {t}" for n, t in records.dtypes if n != "key") + ", shard int, rank long")
    cuts = materialize(cuts, "shards")
    begins = F.broadcast(cuts.groupBy("shard").agg(F.min("rank").alias("begin")))  # one row for each shard
    return cuts.join(begins, "shard").select(*names, "shard", (F.col("rank") - F.col("begin")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law of near equal bytes.

    Nulls and empty texts have size 1; null doc_ids come first among equal texts; repeated rows have slots of their
    own; an empty table gives no rows.
    """
    placed = assign_shards(record_sizes(docs), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Every row of ``docs`` with its columns and ``slot``, one folder for each shard, sorted by slot.

    Rows travel with their sizes, so null and repeated doc_ids and repeated rows are all written once.  Columns named
    shard or slot are replaced; an empty table writes an empty folder.
    """
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    placed = assign_shards(record_sizes(docs, F.struct(*own).alias("row")), shards)
    rows = placed.select("row.*", "shard", "slot")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
