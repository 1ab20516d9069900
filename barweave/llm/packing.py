"""Best-fit decreasing packing of documents into windows of fixed size.

Documents longer than a window are first cut into full windows.  What is left is an item of 1..size tokens, and items
of one length are alike, so the whole corpus is described by one count for each length.  The plan is made over those
counts: lengths go from long to short, and a segment tree over remaining capacity finds the tightest class of open
windows in which a length still fits.  The plan says, for each length and range of ranks, which windows it gets; its
size depends on the window size alone, never on the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import map_arrow, materialize
from .encoding import encoder, rebatched


class CapacityTree:
    """Segment tree over 0..size: which remaining capacities have open windows."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = np.zeros(2 * self.leaves, np.int64)

    def add(self, capacity: int, windows: int) -> None:
        i = capacity + self.leaves
        while i:
            self.tree[i] += windows
            i >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least ``length`` that an open window has."""
        i = length + self.leaves
        if self.tree[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.leaves:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first window, offset): items of a length with these ranks go, one each, to
    consecutive windows at that offset."""
    tree, open_, plan, windows = CapacityTree(size), {}, [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = size, windows, -(-left // (size // length))
                windows += n
            else:
                first, n = open_[room].pop()
                tree.add(room, -n)
            # the window that took an item is the tightest for the next one, so each is filled before another is begun
            per = room // length
            full, rest = min(n, left // per), 0
            if full < n:
                rest = min(left - full * per, per)
            for begin, many, items in ((first, full, per), (first + full, 1 if rest else 0, rest), (first + full + (1 if rest else 0), n - full - (1 if rest else 0), 0)):
                if not many:
                    continue
                for k in range(items):
                    plan.append((length, rank, many, begin, size - room + k * length))
                    rank += many
                if free := room - items * length:
                    open_.setdefault(free, []).append((begin, many))
                    tree.add(free, many)
            left -= full * per + rest
    return plan


def encode_pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int, blanks: bool = True) -> DataFrame:
    """Encodes whole texts (null: empty), appends ``end_id`` and cuts each document into full windows and a rest.

    Rows: (doc_id, start, length, ids, doc_tokens, part, rank) where rank counts pieces of that length in the task.
    """
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, start long, length int, ids binary, doc_tokens long, part int, rank long"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, seen = TaskContext.get().partitionId(), encoder(vocabulary, blanks), np.zeros(size + 1, np.int64)
        for b in rebatched(batches):
            rows: list[list] = [[] for _ in range(7)]
            for d, ids in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1)), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, size):
                    length = min(size, total - start)
                    for column, value in zip(rows, (d, start, length, ids[4 * start : 4 * (start + length)], total, part, int(seen[length])), strict=True):
                        column.append(value)
                    seen[length] += 1
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "part", "rank"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), pieces, schema)


def pack_pieces(pieces: DataFrame, size: int) -> DataFrame:
    """Adds (sequence_id, offset) to materialized pieces by best-fit decreasing over the whole table.

    A piece's rank among all pieces of its length is its rank in the task that wrote it plus the counts of earlier
    tasks.  Only one count for each length (``size`` of them) reaches the driver.  An empty table gives no rows.
    """
    spark = pieces.sparkSession
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = by_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit_plan(counts, size)
    lengths = np.array([p[0] for p in plan], np.int64)
    ranks, windows, offsets = (np.array([p[k] for p in plan], np.int64) for k in (1, 3, 4))
    lo = np.searchsorted(-lengths, -np.arange(size + 1), side="left")
    hi = np.searchsorted(-lengths, -np.arange(size + 1), side="right")

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + (["ids"] if "ids" in pieces.columns else [])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "global_rank"))
            row = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                row[own] = lo[n] + np.searchsorted(ranks[lo[n] : hi[n]], rank[own], side="right") - 1
            yield pa.record_batch([*[b.column(n) for n in names], pa.array(windows[row] + rank - ranks[row]), pa.array(offsets[row])], [*names, "sequence_id", "offset"])

    ranked = pieces.join(before, ["length", "part"]).withColumn("global_rank", F.col("rank") + F.col("before"))
    columns = [n for n in names if n != "ids_crc32"]
    ranked = ranked.select(*columns, "ids_crc32", "global_rank") if "ids_crc32" in ranked.columns else ranked.select(*columns, F.crc32("ids").alias("ids_crc32"), "global_rank")
    kinds = dict(ranked.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", sequence_id long, offset long"
    return map_arrow(ranked, place, schema)


def packed_sequences(packed: DataFrame, pad_id: int, size: int) -> DataFrame:
    """The windows themselves: (sequence_id, used, ids) with ids padded to ``size``; ``packed`` must hold ids."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "length"))).alias("p"))
    used = F.aggregate("p", F.lit(0), lambda a, x: a + x["length"])
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), F.lit(size) - F.col("used")))
    joined = F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", used.alias("used"), joined.alias("b")).select("sequence_id", "used", F.concat("b", pad).alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Packs whole documents into windows of ``size`` tokens; one row for each piece.

    Every piece (with its ids if ``keep_ids``) is written to the shared folder once, so that ranks never change when an
    executor is lost.  Null doc_ids and repeated rows are packed like any other row; null and empty texts are the end id
    alone; texts longer than a window are cut; an empty table gives no rows; other columns don't matter.
    """
    pieces = encode_pieces(docs, vocabulary, size, end_id).withColumn("ids_crc32", F.crc32("ids"))
    return pack_pieces(materialize(pieces if keep_ids else pieces.drop("ids"), "pieces"), size)
