"""Token-id files: a concatenated id array whose document boundaries are Elias-Fano encoded.

A file row holds a run of documents in ascending doc_id order::

    header   magic, documents, leading null doc_ids, tokens, id width, sizes of the two encoded sequences
    doc_ids  Elias-Fano: doc_id less the smallest one
    bounds   Elias-Fano: token offset at which each document begins, and the end
    ids      unsigned little-endian integers of 2 bytes (4 where the vocabulary needs them)

An Elias-Fano sequence of n values below u takes about 2 + log2(u / n) bits a value: the low bits are packed, the high
bits are a unary bit vector, and every 64th set bit's place is kept so that one value is found without a scan.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, scratch_path
from .encoding import encoder, rebatched

_HEADER, _EF = struct.Struct("<4sIIQBqII"), struct.Struct("<IBII")
MAGIC, SELECT_STEP = b"EFID", 64
#: Tokens in one file row; a longer document has a row of its own.
RUN_TOKENS = 1 << 20
#: Bytes of text in a range of doc_ids, and the most ranges; a range is sorted by one task, which may spill.
RANGE_BYTES, RANGES = 16 << 20, 10_000
_NULL = np.iinfo(np.int64).min


class EliasFano:
    """A non-decreasing sequence of unsigned integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        return cls(n, low_bits, np.packbits(low.astype(np.uint8), bitorder="little"), np.packbits(high, bitorder="little"), places[::SELECT_STEP].astype("<u4"))

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.int64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a]
        return bits.reshape(-1, self.low_bits) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def slice(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1: only the bits between the kept places around them are read."""
        first, after = i // SELECT_STEP, (j - 1) // SELECT_STEP + 1
        if i >= j:
            return np.zeros(0, np.int64)
        start = int(self.samples[first])
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        places = np.flatnonzero(np.unpackbits(self.high[start // 8 : -(-end // 8)], bitorder="little")) + start // 8 * 8
        places = places[places >= start][i - first * SELECT_STEP : j - first * SELECT_STEP]
        return ((places - np.arange(i, j)) << self.low_bits) | self._lows(i, j)

    def all(self) -> np.ndarray:
        return self.slice(0, self.n)

    def get(self, i: int) -> int:
        """The i-th value: from the nearest kept place on, set bits are counted."""
        k, place = i % SELECT_STEP, int(self.samples[i // SELECT_STEP])
        start = place // 8
        while True:  # one kept place to the next, at most
            bits = np.flatnonzero(np.unpackbits(self.high[start : start + 64], bitorder="little")) + start * 8
            bits = bits[bits >= place]
            if len(bits) > k:
                return ((int(bits[k]) - i) << self.low_bits) | int(self._lows(i, i + 1)[0])
            k, start = k - len(bits), start + 64
            place = start * 8

    def to_bytes(self) -> bytes:
        return _EF.pack(self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, n_low, n_high = _EF.unpack_from(raw)
        body = np.frombuffer(raw, np.uint8, offset=_EF.size)
        return cls(n, low_bits, body[:n_low], body[n_low : n_low + n_high], np.frombuffer(body[n_low + n_high :].tobytes(), "<u4"))


class TokenRun:
    """One file row: random access to a document's ids through the encoded boundaries."""

    def __init__(self, raw: bytes):
        magic, self.n, self.nulls, self.tokens, width, self.base, a, b = _HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEADER.size
        self.doc_ids = EliasFano.from_bytes(raw[at : at + a])
        self.bounds = EliasFano.from_bytes(raw[at + a : at + a + b])
        self.ids = np.frombuffer(raw, f"<u{width}", offset=at + a + b)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.get(i) : self.bounds.get(i + 1)]

    @staticmethod
    def write(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
        known = np.array([d for d in doc_ids if d is not None], np.int64)
        base = int(known[0]) if len(known) else 0
        names = EliasFano.of((known - base).astype(np.uint64)).to_bytes()
        bounds = EliasFano.of(np.concatenate([[0], np.cumsum(lengths)])).to_bytes()
        return _HEADER.pack(MAGIC, len(doc_ids), len(doc_ids) - len(known), sum(lengths), width, base, len(names), len(bounds)) + names + bounds + ids


def range_cuts(docs: DataFrame) -> np.ndarray:
    """Lower bounds of the ranges of doc_id but the first one, ascending; a doc_id that needs several ranges is repeated
    (null: the smallest number).  The number of ranges follows the bytes of text."""
    total, rows, known = docs.agg(F.sum(F.octet_length("text")), F.count("*"), F.count("doc_id")).first()
    n = max(1, min(RANGES, -(-((total or 0) + 8 * rows) // RANGE_BYTES)))
    nulls = (rows - known) * n // max(rows, 1)
    rest = n - nulls
    cuts = docs.agg(F.percentile_approx("doc_id", [k / rest for k in range(1, rest)], 100_000)).first()[0] if rest > 1 and known else []
    return np.array([_NULL] * nulls + sorted(cuts or []), np.int64)


def buckets(cuts: np.ndarray, doc_ids: np.ndarray, spread: list[bytes]) -> np.ndarray:
    """The range of each document; documents of a doc_id that has several ranges go by a checksum of their ids."""
    lo, hi = np.searchsorted(cuts, doc_ids, "left"), np.searchsorted(cuts, doc_ids, "right")
    for i in np.flatnonzero(hi - lo > 1):
        hi[i] = lo[i] + 1 + zlib.crc32(spread[i]) % (hi[i] - lo[i])
    return hi


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, blanks: bool = False) -> DataFrame:
    """Encodes whole texts, appends ``end_id`` to each and writes token files in ascending doc_id order to ``path``.

    Returns the file rows as read back: (bucket, run, begin, n_docs, n_tokens, raw).  A null text has only its end id;
    null doc_ids come first; rows of one doc_id are in no fixed order, repeated rows each have their place; an empty
    table gives no rows; other columns don't matter.  Ids have 2 bytes where the vocabulary and ``end_id`` fit them,
    else 4.  Ranges of doc_id come from the column's quantiles, so one shuffle of the ids sorts everything; a range is
    written as runs of bounded size.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = range_cuts(docs)
    width = 2 if max(end_id, encoder(vocabulary, blanks).tokenizer.get_vocab_size() - 1) < 1 << 16 else 4
    dtype, end = f"<u{width}", np.array([end_id], f"<u{width}").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, blanks)
        for b in rebatched(batches):
            ids = [np.frombuffer(x, "<u4").astype(dtype).tobytes() + end for x in enc.encode_all(b.column(1))]
            of = b.column(0)
            bucket = buckets(cuts, of.fill_null(_NULL).to_numpy(zero_copy_only=False), ids)
            yield pa.record_batch([pa.array(bucket, pa.int32()), of, pa.array(ids, pa.binary())], ["bucket", "doc_id", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lengths, parts, size, bucket, run, begin = [], [], [], 0, None, 0, 0

        def flush() -> pa.RecordBatch:
            raw = TokenRun.write(names, lengths, b"".join(parts), width)
            return pa.record_batch([pa.array([bucket], pa.int32()), pa.array([run], pa.int32()), pa.array([begin]), pa.array([len(names)]), pa.array([size]), pa.array([raw], pa.binary())], ["bucket", "run", "begin", "n_docs", "n_tokens", "raw"])

        for b in batches:
            for k, d, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if names and (k != bucket or size + len(x) // width > RUN_TOKENS):
                    yield flush()
                    begin, run = (begin + size, run + 1) if k == bucket else (0, 0)
                    names, lengths, parts, size = [], [], [], 0
                bucket = k
                names.append(d)
                lengths.append(len(x) // width)
                parts.append(x)
                size += len(x) // width
        if names:
            yield flush()

    rows = map_arrow(docs, encode, "bucket int, doc_id long, ids binary")
    rows = rows.repartitionById(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "ids")
    runs = map_arrow(rows, pack, "bucket int, run int, begin long, n_docs long, n_tokens long, raw binary")
    runs.write.parquet(path)
    return spark.read.schema(runs.schema).parquet(path)


def read_token_files(runs: DataFrame) -> DataFrame:
    """Documents of token files: (doc_id, start, n_tokens, ids) with ids as 32-bit little-endian integers.

    The driver holds one number for each range, of which there are RANGES at most.
    """
    totals = {r[0]: r[1] for r in runs.groupBy("bucket").agg(F.sum("n_tokens")).collect()}
    starts, at = {}, 0
    for k in sorted(totals):
        starts[k], at = at, at + totals[k]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, begin, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                run = TokenRun(raw)
                for i in range(0, run.n, 2000):
                    j = min(run.n, i + 2000)
                    bounds = run.bounds.slice(i, j + 1)
                    names = [None] * (min(j, run.nulls) - min(i, run.nulls)) + (run.doc_ids.slice(max(i - run.nulls, 0), max(j - run.nulls, 0)) + run.base).tolist()
                    ids = run.ids[bounds[0] : bounds[-1]].astype("<u4").tobytes()
                    at = (4 * (bounds - bounds[0])).tolist()
                    each = [ids[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
                    yield pa.record_batch([pa.array(names, pa.int64()), pa.array(bounds[:-1] + (starts[bucket] + begin)), pa.array(np.diff(bounds)), pa.array(each, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return map_arrow(runs.select("bucket", "begin", "raw"), decode, "doc_id long, start long, n_tokens long, ids binary")


def token_file_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the token files of ``docs`` to the shared folder and describes each document from them."""
    runs = write_token_files(docs, vocabulary, scratch_path(docs.sparkSession, "token-files"))
    return read_token_files(runs).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
