"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is the set of its windows of ``window`` words; a document is contaminated where it contains one.  A
window is a set of word shingles.  With all of them required, the necessary prefix of a window is its rarest shingle,
so rarity is counted over all documents, each window is filed under its rarest shingle, and a document looks up its own
shingles there.  A hit fixes where the window would begin; length and position bounds discard what would stick out of
the document, and the words of the rest are compared exactly.

Words of items are numbered, so a window is a row of numbers and a document word that no item has is -1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import alnum_words, if_small, map_arrow, materialize, utf8

SHINGLE = 3
#: UTF-8 bytes of item text in one index.  More items are joined block by block.
INDEX_BYTES = 2 << 20


class WindowIndex:
    """Windows of a block of items, filed under one shingle each; a word's number comes from ``words``."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.words: dict[bytes, int] = {}
        found: dict[tuple[int, ...], list[int]] = {}
        self.items = [name for name, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [self.words.setdefault(w, len(self.words)) for w in alnum_words(text)]
            n = min(window, len(ids))
            for at in range(len(ids) - n + 1) if n else ():
                owners = found.setdefault(tuple(ids[at : at + n]), [])
                if not owners or owners[-1] != k:
                    owners.append(k)
        self.windows, self.owners = list(found), list(found.values())

    def shingles(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Codes and places of runs of 1, 2 .. SHINGLE item words; codes of different lengths never meet."""
        base, out = np.uint64(len(self.words) + 1), []
        for k in range(1, min(SHINGLE, len(ids)) + 1):
            rows = [ids[j : len(ids) - k + 1 + j] for j in range(k)]
            at = np.flatnonzero(np.logical_and.reduce([r >= 0 for r in rows]))
            code = np.zeros(len(at), np.uint64)
            for r in rows:
                code = code * base + (r[at] + 1).astype(np.uint64)
            out.append((code, at))
        return out

    def _own(self, window: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        return self.shingles(np.array(window, np.int64))[-1]

    def vocabulary(self) -> np.ndarray:
        """Codes of all shingles that a window can be filed under."""
        return np.array(sorted(set(chain.from_iterable(self._own(w)[0].tolist() for w in self.windows))), np.uint64)

    def order(self, frequency: dict[int, int]) -> None:
        """Files every window under its rarest shingle (ties: the smallest code)."""
        self.filed: dict[int, list[tuple[int, int]]] = {}
        for w, window in enumerate(self.windows):
            code, at = (x.tolist() for x in self._own(window))
            best = min(range(len(code)), key=lambda i: (frequency.get(code[i], 0), code[i]))
            self.filed.setdefault(code[best], []).append((w, at[best]))
        self.codes = np.array(sorted(self.filed), np.uint64)

    def number(self, words: list[bytes]) -> np.ndarray:
        get = self.words.get
        return np.array([get(w, -1) for w in words], np.int64)

    def hits(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(begin, end, window) of every occurrence."""
        ids, out = self.number(words), []
        if not len(self.codes) or not (ids >= 0).any():
            return out
        for code, at in self.shingles(ids):
            place = np.searchsorted(self.codes, code)
            place[place == len(self.codes)] = 0
            for i in np.flatnonzero(self.codes[place] == code):
                for w, offset in self.filed[int(code[i])]:
                    window, begin = self.windows[w], int(at[i]) - offset
                    if begin >= 0 and begin + len(window) <= len(ids) and ids[begin : begin + len(window)].tolist() == list(window):
                        out.append((begin, begin + len(window), w))
        return out


def _frequencies(docs: DataFrame, index: Broadcast, codes: np.ndarray) -> dict[int, int]:
    """In how many documents each item shingle occurs; the result has at most one number for each item shingle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, total = index.value, np.zeros(len(codes), np.int64)
        for b in batches:
            for text in utf8(b.column(0)):
                ids = ix.number(alnum_words(text))
                if len(codes) and (ids >= 0).any():
                    own = np.unique(np.concatenate([c for c, _ in ix.shingles(ids)]))
                    place = np.searchsorted(codes, own)
                    place[place == len(codes)] = 0
                    total[place[codes[place] == own]] += 1
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["k", "n"])

    rows = map_arrow(docs.select("text"), count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return {int(codes[r["k"]]): r["n"] for r in rows}


def _digest(n_words: int, spans: list[tuple[int, int]], names: list[str]) -> tuple[int, int, str]:
    hit = np.zeros(n_words, bool)
    for begin, end in spans:
        hit[begin:end] = True
    names = sorted({n for n in names if n is not None})
    return int(hit.sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


def _blocks(items: DataFrame) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in blocks of about INDEX_BYTES; only one is on the driver at a time."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // INDEX_BYTES) or 1
    for k in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(None if r[0] is None else str(r[0]), r[1].encode()) for r in own.select("item_id", "text").where("text is not null").collect()]


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = 10, spans: bool = False) -> DataFrame:
    """One row for each document: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated[, spans]).

    A word is hit if it lies in any occurrence of an item window; an item of fewer words is one window.  ``spans`` adds
    the word ranges [begin, end).  Null and empty texts have no words and hit nothing; repeated rows give repeated rows;
    an empty benchmark leaves every document clean; windows of an item without an item_id hit words, but name no item.  The index of a block of items is broadcast: its size is bounded by
    INDEX_BYTES of text.  With several blocks, the hits of each go to the shared folder and are joined by document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("key"))
    return _hits(rows, items, window, spans).drop("key")


def _hits(docs: DataFrame, items: DataFrame, window: int, spans: bool) -> DataFrame:
    """``benchmark_hits`` of (doc_id, text, key) with the key."""
    spark, indexes = docs.sparkSession, []
    for block in _blocks(items):
        index = WindowIndex(block, window)
        codes = index.vocabulary()
        index.order(_frequencies(docs, spark.sparkContext.broadcast(index), codes) if len(codes) else {})
        indexes.append(spark.sparkContext.broadcast(index))
    if len(indexes) == 1:
        return _one_block(docs, indexes[0], spans)
    hashed = docs.withColumn("text_key", F.sha2("text", 256))
    every = _block_hits(hashed, indexes[0])
    for index in indexes[1:]:
        every = every.unionByName(_block_hits(hashed, index))
    every = materialize(every, "benchmark-hits").distinct()
    every = every.groupBy("text_key").agg(F.collect_set("begin_end").alias("at"), F.collect_set("item").alias("items"))
    return _from_blocks(hashed.join(every, "text_key", "left"), spans)


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
_NAMES = ["doc_id", "key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
_SCHEMA = "doc_id long, key long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _rows(names: list[pa.Array], rows: list[tuple], spans: list[list] | None) -> pa.RecordBatch:
    arrays = [*names, *[pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)]]
    if spans is None:
        return pa.record_batch(arrays, _NAMES)
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    return pa.record_batch([*arrays, pa.array([[{"begin": a, "end": b} for a, b in sorted(set(s))] for s in spans], kind)], [*_NAMES, "spans"])


def _out(spans: bool) -> str:
    return _SCHEMA + (", spans array<struct<begin: int, end: int>>" if spans else "")


def _one_block(docs: DataFrame, index: Broadcast, spans: bool) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for b in batches:
            rows, places = [], []
            for text in utf8(b.column(1)):
                words = alnum_words(text)
                hits = ix.hits(words)
                at = [(x, y) for x, y, _ in hits]
                n_hit, n_items, sha = _digest(len(words), at, [ix.items[k] for _, _, w in hits for k in ix.owners[w]])
                rows.append((len(words), n_hit, n_items, sha, n_hit > 0))
                places.append(at)
            yield _rows([b.column(0), b.column(2)], rows, places if spans else None)

    return map_arrow(docs.select("doc_id", "text", "key"), scan, _out(spans))


def _block_hits(keyed: DataFrame, index: Broadcast) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for b in batches:
            keys, at, names = [], [], []
            for key, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                for begin, end, w in ix.hits(alnum_words(text)):
                    for k in ix.owners[w]:
                        keys.append(key)
                        at.append(begin << 32 | end)
                        names.append(ix.items[k])
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array(at, pa.int64()), pa.array(names, pa.string())], ["text_key", "begin_end", "item"])

    return map_arrow(keyed.select("text_key", "text"), scan, "text_key string, begin_end long, item string")


def _from_blocks(joined: DataFrame, spans: bool) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, places = [], []
            for text, at, names in zip(utf8(b.column(1)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                n, own = len(alnum_words(text)), [(x >> 32, x & 0xFFFFFFFF) for x in at or ()]
                n_hit, n_items, sha = _digest(n, own, names or [])
                rows.append((n, n_hit, n_items, sha, n_hit > 0))
                places.append(own)
            yield _rows([b.column(0), b.column(2)], rows, places if spans else None)

    return map_arrow(joined.select("doc_id", "text", "key", "at", "items"), digest, _out(spans))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Documents without a benchmark window, with all their columns.

    Rows are judged by their own texts: rows of one doc_id, or without one, with other texts stay.  Texts of null and
    empty documents and an empty benchmark drop nothing; names of other columns don't matter.  Names of the rows to drop
    are written first, so that the join sees their size and moves no texts while they are few.
    """
    key = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key"))
    hits = materialize(_hits(rows, items, window, False).where("contaminated").select("doc_id", "key").distinct(), "contaminated")
    hits = if_small(hits)
    return docs.join(hits, docs["doc_id"].cast("long").eqNullSafe(hits["doc_id"]) & (F.xxhash64(docs["text"]) == hits["key"]), "left_anti")
