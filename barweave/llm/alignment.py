"""Alignment of two tokenizers' tokens over the bytes of each text.

A is a byte-level BPE vocabulary over a space and the text, B a sentencepiece model that adds the space itself.  Each
byte of a stretch of text gets a label: no token ends there, one of A's, one of B's, or both.  A regular expression
scans the label string for spans that run up to each both-label, and the labels counted in a span say how many tokens
of A and B make up its group.

Both vocabularies end a token wherever white space begins, so a text's groups are those of its stretches (white space
and the word after it), one after another.  A stretch is aligned once and looked up from then on.  Counts of linked id
pairs are summed over the corpus; they are handed to all tasks if there are few of them, and joined if there are many.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, map_arrow
from .encoding import _BYTE_CHARS, Pool

#: Stretches that a worker remembers, and their characters in all.
MEMO_WORDS, MEMO_CHARS = 500_000, 16_000_000
#: Distinct id pairs up to which their counts are handed to every task: 16 MB.
BROADCAST_PAIRS = 1_000_000
#: A group's span of labels ends at the next byte where tokens of both end.
_GROUP = re.compile(rb"[^x]*x")
#: Where a text isn't words with one blank between them; where a stretch of such a text begins.
_ODD = re.compile(r"(?:^|\s) ")
_CUT = re.compile(r"(?<=\S) ")
#: An id pair is one number: B's id has 15 bits.
B_BITS = 15


def label_string(a_ends: np.ndarray, b_ends: np.ndarray, size: int) -> bytes:
    """For each byte: ``.`` no token ends there, ``a`` or ``b`` one of A's or B's does, ``x`` both do."""
    out = np.zeros(size, np.uint8)
    out[a_ends - 1] += 1
    out[b_ends - 1] += 2
    return np.frombuffer(b".abx", np.uint8)[out].tobytes()


def group_sizes(labels: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and tokens of B in each group."""
    ends = np.array([m.end() for m in _GROUP.finditer(labels)], np.int64)
    marks = np.frombuffer(labels, np.uint8)
    both = marks == 0x78
    return tuple(np.diff(np.cumsum(np.append(False, (marks == mark) | both))[ends], prepend=0) for mark in b"ab")


def stretches(text: str) -> list[str]:
    """A text's stretches, each without the blank that it begins with."""
    if not _ODD.search(text):
        return text.split(" ")
    whole = " " + text
    cuts = [0, *(m.start() for m in _CUT.finditer(whole)), len(whole)]
    return [whole[i + 1 : j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


class Aligner:
    """Groups of stretches: their ids as text, their sizes, and the linked (last) ids of each group."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of_char = {c: bytes([b]) for b, c in _BYTE_CHARS.items()}
        plain = lambda t: b"".join(of_char.get(c) or (bytes([ord(c)]) if ord(c) < 256 else c.encode()) for c in t)
        self.a_bytes = {i: plain(t) for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.blank = self.b.piece_to_id("▁")
        self.a_size = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_size[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.top = max(len(self.a_size), len(self.b_size))
        self.said = [f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(self.top)]  # an id and what follows it
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[bytes] = []
        # of each stretch: tokens of A, of B, groups (-1 where the bytes aren't the text's); where its linked pairs begin, and how many
        self.table = np.zeros((1024, 5), np.int64)
        self.pool = Pool()
        self.chars = 0

    def _learn(self, words: list[str]) -> None:
        """Aligns stretches all at once: their bytes are one string of labels, which no group leaves, as tokens of both end
        with each stretch."""
        first, raw = len(self.groups), [(" " + w).encode() for w in words]
        sides = [([e.ids for e in self.a.encode_batch([" " + w for w in words], add_special_tokens=False)], self.a_bytes.__getitem__), ([x or [self.blank] for x in self.b.encode(words, num_threads=1)], self.b_bytes.__getitem__)]
        bad = np.zeros(len(words), bool)
        for ids, spelt in sides:
            if b"".join([spelt(i) for x in ids for i in x]) != b"".join(raw):
                bad |= np.array([b"".join(map(spelt, x)) != r for x, r in zip(ids, raw, strict=True)])
        good = np.flatnonzero(~bad).tolist()
        a, b = ([ids[k] for k in good] for ids, _ in sides)
        ends = np.cumsum([len(raw[k]) for k in good], dtype=np.int64)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        a, b = (np.array([i for x in ids for i in x], np.int64) for ids in (a, b))
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        in_a, in_b = group_sizes(label_string(a_ends, b_ends, int(ends[-1]) if len(ends) else 0))
        last_a, last_b = np.cumsum(in_a), np.cumsum(in_b)  # tokens up to each group's end
        groups = np.searchsorted(a_ends[last_a - 1], ends, side="right")  # groups up to each stretch's end
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[last_a - 1], mark_b[last_b - 1] = 1, 2
        mark_b[last_b[groups - 1] - 1] = 3
        place_a = np.arange(len(a)) + np.repeat(last_b - in_b, in_a)
        place_b = np.arange(len(b)) + np.repeat(last_a, in_b)
        spoken = np.zeros(len(a) + len(b), np.int64)
        spoken[place_a], spoken[place_b] = a + mark_a * self.top, b + mark_b * self.top
        spoken = list(map(self.said.__getitem__, spoken.tolist()))
        stops = np.cumsum(n_a + n_b).tolist()
        texts = ["".join(spoken[i:j]).encode() for i, j in zip([0, *stops], stops, strict=False)]
        rows = np.zeros((len(words), 5), np.int64)
        rows[:, 2] = -1
        rows[good, 0], rows[good, 1], rows[good, 2] = n_a, n_b, np.diff(groups, prepend=0)
        rows[:, 3], rows[:, 4] = self.pool.add((a[last_a - 1] << B_BITS | b[last_b - 1]).astype(np.uint32), np.maximum(rows[:, 2], 0))
        self.groups += [b""] * len(words)
        for k, text in zip(good, texts, strict=True):
            self.groups[first + k] = text
        if len(self.groups) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((2 * len(self.groups) - len(self.table), 5), np.int64)])
        self.table[first : len(self.groups)] = rows

    def places(self, words: list[str]) -> list[int]:
        """Where the tables have each stretch."""
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if new:
            self.at.update(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
            self._learn(new)
            self.chars += sum(map(len, new))
        return list(map(self.at.__getitem__, words))

    def trim(self) -> None:
        """Full tables aren't kept beyond a batch."""
        if len(self.at) > MEMO_WORDS or self.chars > MEMO_CHARS:
            self._clear()

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text its sizes (tokens of A, of B, groups) and groups' digest; and for all texts' distinct links the
        text, the id pair and how often."""
        words, ends = [], [0]
        for t in texts:
            if t:
                words += stretches(t)
            ends.append(len(words))
        at = self.places(words)
        rows = self.table[np.array(at, np.int64)]
        sizes = rows[:, :3]
        bad = np.concatenate([[0], np.cumsum(sizes[:, 2] < 0)])[ends]
        bad = bad[1:] > bad[:-1]
        sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(sizes, axis=0)])[ends]
        totals = np.where(bad[:, None], 0, sums[1:] - sums[:-1])
        digests = ["" if not n else hashlib.sha256(b";".join(map(self.groups.__getitem__, at[i:j]))).hexdigest() for i, j, n in zip(ends[:-1], ends[1:], totals[:, 0].tolist(), strict=True)]
        run = rows[:, 3:]
        of = np.repeat(np.arange(len(texts)), np.diff(ends))
        run[bad[of], 1] = 0
        offsets = np.cumsum(run[:, 1]) - run[:, 1]
        linked = self.pool.ids[np.repeat(run[:, 0] - offsets, run[:, 1]) + np.arange(run[:, 1].sum())]
        keys, times = np.unique(np.repeat(of, run[:, 1]) << 32 | linked.astype(np.int64), return_counts=True)
        self.trim()
        return totals, digests, keys >> 32, keys & 0xFFFFFFFF, times


@functools.cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker, so that what it remembers outlives a task."""
    return Aligner(a_path, b_path)


def _aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<int>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, tool = TaskContext.get().partitionId() << 40, aligner(a_path, b_path)
        for b in batches:
            totals, digests, of, pairs, times = tool.align(b.column(1).to_pylist())
            cuts = pa.array(np.searchsorted(of, np.arange(len(b) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (pairs, times)]
            columns = [pa.array(row + np.arange(len(b))), b.column(0), *(pa.array(np.ascontiguousarray(totals[:, k])) for k in range(3)), pa.array(digests, pa.string()), *lists]
            yield pa.record_batch(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])
            row += len(b)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def _pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): links of each id pair over all documents; a task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def emit() -> pa.RecordBatch:
            return pa.record_batch([pa.array(keys.astype(np.int32)), pa.array(sums)], ["pair", "n"])

        for b in batches:
            more, times = (np.asarray(b.column(k).flatten()).astype(np.int64) for k in (0, 1))
            keys, which = np.unique(np.concatenate([keys, more]), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, which, np.concatenate([sums, times]))
            sums = total
            if len(keys) > BROADCAST_PAIRS:
                yield emit()
                keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(keys):
            yield emit()

    counted = map_arrow(aligned.select("pairs", "times"), run, "pair int, n long")
    return counted.groupBy("pair").agg(F.sum("n").alias("n"))


def token_alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    Each group links its last token of A with its last of B, as only those end together.  ``n_best``: links whose id
    pair's count over all rows is the highest of its B id; ``count_sum``: those counts, summed over the links.  Null
    and empty texts, and texts whose tokens' bytes aren't a space and the text, have no tokens: zeros and ''.  Repeated
    rows count each; an empty table gives no rows; other columns don't matter.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    aligned = scratch.keep(_aligned(docs, a_path, b_path), "aligned")
    counts = scratch.keep(_pair_counts(aligned), "counts")
    b_id = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    rated = counts.join(highest, b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    told = ["doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links")]
    if counts.count() > BROADCAST_PAIRS:
        each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
        sums = each.join(rated, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
        d = aligned.drop("pairs", "times").join(sums, "row", "left")
        return d.select(*told, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
    table = rated.orderBy("pair").toArrow()
    known = spark.sparkContext.broadcast(tuple(table.column(k).to_numpy() for k in range(3)))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = known.value
        for b in batches:
            lists, own = b.column(4), len(b)
            of = np.repeat(np.arange(own), np.asarray(lists.value_lengths()))
            at = np.searchsorted(pairs, np.asarray(lists.flatten()))
            times = np.asarray(b.column(5).flatten()).astype(np.int64)
            sums = [np.zeros(own, np.int64), np.zeros(own, np.int64)]
            for total, x in zip(sums, (times * best[at], times * counts[at]), strict=True):
                np.add.at(total, of, x)
            yield pa.record_batch([*(b.column(k) for k in range(4)), b.column(3), *map(pa.array, sums), b.column(6)], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return map_arrow(aligned.select("doc_id", "n_a", "n_b", "n_groups", "pairs", "times", "groups_sha256"), rate, schema)
