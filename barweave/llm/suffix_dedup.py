"""Byte strings of a given length that start more than once in a corpus, by a distributed difference-cover suffix sort.

1. Every window of LENGTH bytes has an anchor: the place of its least hashed 16-gram, which depends on the window's bytes
   alone.  Equal windows have their anchors at the same offset, and so the same bytes around them.  An anchor's windows
   are of two kinds, by their distance to it; what all windows of a kind have in common (three quarters of LENGTH) is
   hashed and counted over the corpus.  Only stretches of anchors that recur so are worked on further.
2. Such a stretch is a string of symbols, one for the bytes from each anchor to the next; equal symbols in a row (a word said
   over and over) are one symbol, whose windows repeat in itself.  Its suffixes are sorted by
   the difference-cover algorithm modulo 3: triples of symbols at the sampled places are sorted and named; where a name
   is shared by suffixes that aren't told apart yet, the algorithm recurses on the names; the remaining suffixes are
   merged in by a symbol or two and the rank of the sampled suffix behind them.  All sorts are range-partitioned, and a
   merge is a count of rows in two sorted lists.
3. Adjacent suffixes are compared: a common prefix of LENGTH bytes or more says which windows recur.  Windows that no
   such prefix covers (at the ends of a match, between two symbols, at the edge of two sorted ranges) are told apart by
   128-bit codes, together with one of each kind of windows behind the same anchor bytes; slices of neighbouring windows
   whose common bytes don't recur are left out first.
4. Texts that occur twice are removed whole where they have LENGTH bytes; of them one takes part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import Scratch, grouped, if_small, map_arrow
from .shingles import EXACT, STEP, codes_of, mix, slabs, span_sums

LENGTH, GRAM = 200, 16
#: Windows whose anchors are found at once: few, so that their hashes stay in a core's cache.
SEGMENT = 1 << 15
#: Neighbouring windows that are looked for together, and the share of suffixes that a recursion leaves to them.
SLICE, SPARE = 16, 0.02
_OTHER = mix(EXACT, 0x1F3)
_PLACE, _FAR, _MIX = np.uint64((1 << 24) - 1), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)


def anchors(data: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` bytes the place of its anchor: of the grams that begin in its first half, the least
    (ties: the first)."""
    half, out = length // 2, []
    for at in range(0, max(0, len(data) - length + 1), SEGMENT):
        part = data[at : at + SEGMENT + length - 1]
        n = len(part) - GRAM + 1
        eights = np.ndarray((n + 8,), "<u8", np.ascontiguousarray(part), strides=(1,))
        gram = (eights[:n] * STEP) ^ (eights[8:] * _FAR)
        gram ^= gram >> np.uint64(29)
        gram *= _MIX
        least = (gram & ~_PLACE) | np.arange(n, dtype=np.uint64)
        size = 1
        while 2 * size <= half:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if half > size:
            least = np.minimum(least[: len(least) - (half - size)], least[half - size :])
        out.append(at + (least[: len(part) - length + 1] & _PLACE).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, first window, last window) of each run of windows with one anchor, over a slab of rows."""
    n = np.maximum(np.diff(offsets) - length + 1, 0)
    rows = np.repeat(np.arange(len(n)), n)
    p = np.arange(len(rows)) + np.repeat(offsets[:-1] - (np.cumsum(n) - n), n)
    a = anchors(data, length)[p] if len(p) else p
    first = np.ones(len(p), bool)
    first[1:] = (a[1:] != a[:-1]) | (rows[1:] != rows[:-1])
    last = np.append(first[1:], True)[: len(p)]
    return rows[first], a[first], p[first], p[last]


def code(data: np.ndarray, s: np.ndarray, e: np.ndarray, values: np.ndarray = EXACT) -> np.ndarray:
    """A 64-bit code of each span; spans ascend."""
    return codes_of(span_sums(data, s, e, values), e - s).view(np.int64)


def _lists(cuts: np.ndarray, *columns: tuple[np.ndarray, pa.DataType]) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x.astype(t.to_pandas_dtype()), t)) for x, t in columns]


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"))


def _anchored(docs: DataFrame, length: int) -> DataFrame:
    """Each row's text by its codes, size and digest, and its anchors: place, first and last window, and the codes of the
    bytes that its near windows have in common, and its far ones (null without such windows)."""
    schema = "row long, doc_id long, t1 long, t2 long, n_bytes long, whole string, a array<int>, lo array<int>, hi array<int>, near array<long>, far array<long>"
    half, quarter = length // 2, length // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            at = 0
            for data, offsets in slabs(b.column(1)):
                n = len(offsets) - 1
                of, a, lo, hi = runs(data, offsets, length)
                cuts = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
                kinds = []
                for has, begin, size in ((a - hi < quarter, 0, length - quarter + 1), (a - lo >= quarter, quarter, quarter + length - half + 1)):
                    s, k = a[has] - begin, np.zeros(len(a), np.uint64)
                    k[has] = mix(code(data, s, s + size).view(np.uint64), begin)
                    kinds.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(k.view(np.int64), mask=~has)))
                whole = [hashlib.sha256(data[i:j]).hexdigest() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                base, i32 = offsets[:-1][of], pa.int32()
                lists = _lists(cuts, (a - base, i32), (lo - base, i32), (hi - base, i32))
                columns = [pa.array(row + np.arange(n)), *(b.column(k).slice(at, n) for k in (0, 2, 3)), pa.array(np.diff(offsets)), pa.array(whole), *lists, *kinds]
                yield pa.record_batch(columns, ["row", "doc_id", "t1", "t2", "n_bytes", "whole", "a", "lo", "hi", "near", "far"])
                at, row = at + n, row + n

    return map_arrow(_named(docs), run, schema)


def _marked(rows: DataFrame, keys: list[str], only: bool = False) -> DataFrame:
    """Adds again, whether another row has the same keys, and first, whether no earlier one has.  Rows are sorted by the keys,
    so that equal ones lie side by side and are looked at one after another.  ``only``: only rows that have another one, or
    are ``known`` to have one."""
    rows = rows.select(*keys, *(c for c in rows.columns if c not in keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tied = None, False  # the last row so far, and whether the one before it has its keys

        def marked(b: pa.RecordBatch, next_to: np.ndarray) -> pa.RecordBatch:
            same, first = next_to[:-1] | next_to[1:], ~next_to[:-1]
            if only and "known" in b.schema.names:
                same |= np.asarray(b.column(b.schema.get_field_index("known")).cast(pa.int8())) == 1
            b = pa.record_batch([*b.columns, pa.array(same), pa.array(first)], [*b.schema.names, "again", "first"])
            return b.filter(pa.array(same)) if only else b

        for b in batches:
            if not len(b):
                continue
            b = b if held is None else pa.concat_batches([held, b])
            equal = np.ones(len(b) - 1, bool)
            for k in range(len(keys)):
                x = np.asarray(b.column(k))
                equal &= x[1:] == x[:-1]
            next_to = np.concatenate([[tied], equal])
            yield marked(b.slice(0, len(b) - 1), next_to)
            held, tied = b.slice(len(b) - 1), bool(next_to[-1])
        if held is not None:
            yield marked(held, np.array([tied, False]))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return map_arrow(rows.repartition(*keys).sortWithinPartitions(*keys), run, f"{kinds}, again boolean, first boolean")


def _candidates(own: DataFrame) -> DataFrame:
    """(tid, a, lo, hi): the anchors of each text, in lists, that have a code which recurs.  Where a code recurs among the texts
    of a batch, one row keeps it for the others to find; the rest are known and dealt out by their places, so that a
    code of a large part of all rows isn't one task's."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (a, of), (lo, _), (hi, _) = (_flat(b.column(k)) for k in (1, 2, 3))
            tid, x = np.asarray(b.column(0))[of], a << 32 | (a - lo) << 16 | (a - hi)
            codes = pa.concat_arrays([b.column(4).flatten(), b.column(5).flatten()])
            there = np.asarray(codes.is_valid())
            k, tid, x = np.asarray(codes.drop_null()), np.tile(tid, 2)[there], np.tile(x, 2)[there]
            at = np.argsort(k, kind="stable")
            like = k[at][1:] == k[at][:-1]
            later, known = at[1:][like], np.zeros(len(k), bool)
            known[later] = known[at[:-1][like]] = True
            k = k.copy()
            k[later] = mix(tid[later].view(np.uint64) * STEP + x[later].view(np.uint64), 17).view(np.int64)
            yield pa.record_batch([pa.array(k), pa.array(tid), pa.array(x), pa.array(known)], ["k", "tid", "x", "known"])

    coded = map_arrow(own.select("row", "a", "lo", "hi", "near", "far"), listed, "k long, tid long, x long, known boolean")
    found = _marked(coded, ["k"], only=True).groupBy("tid").agg(F.sort_array(F.collect_set("x")).alias("x"))
    place = lambda x: F.shiftright(x, 32)
    lists = {"a": place, "lo": lambda x: place(x) - F.shiftright(x, 16).bitwiseAND(0xFFFF), "hi": lambda x: place(x) - x.bitwiseAND(0xFFFF)}
    return found.select("tid", *(F.transform("x", f).cast("array<int>").alias(c) for c, f in lists.items()))


def _regions(docs: DataFrame, candidates: DataFrame, repeated: bool, length: int) -> DataFrame:
    """Stretches of neighbouring candidates: their bytes, and their anchors and windows by their places there."""
    schema = "tid long, copies long, start long, body binary, a array<int>, lo array<int>, hi array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            (a, of), (lo, _), (hi, _) = (_flat(b.column(k)) for k in range(3, 6))
            first = np.ones(len(a), bool)
            first[1:] = (of[1:] != of[:-1]) | (lo[1:] != hi[:-1] + 1)
            begins = np.flatnonzero(first)
            ends = np.append(begins[1:], len(a))
            start, row = lo[begins], of[begins]
            texts = b.column(2).cast(pa.binary()).to_pylist()
            bodies = [texts[r][x:y] for r, x, y in zip(row.tolist(), start.tolist(), (hi[ends - 1] + length).tolist(), strict=True)]
            base, i32 = np.repeat(start, ends - begins), pa.int32()
            lists = _lists(np.append(begins, len(a)), (a - base, i32), (lo - base, i32), (hi - base, i32))
            yield pa.record_batch([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(start), pa.array(bodies, pa.binary()), *lists], ["tid", "copies", "start", "body", "a", "lo", "hi"])

    same = (docs["t1"] == candidates["__t1"]) & (docs["t2"] == candidates["__t2"]) & docs["doc_id"].eqNullSafe(candidates["__doc"])
    keys = if_small(candidates.select("__t1", "__t2", "__doc"))
    docs = docs.join(keys, (docs["t1"] == keys["__t1"]) & (docs["t2"] == keys["__t2"]) & docs["doc_id"].eqNullSafe(keys["__doc"]), "left_semi")
    found = map_arrow(docs.join(candidates, same).select("tid", "copies", "text", "a", "lo", "hi"), run, schema)
    if not repeated:
        return found
    return found.groupBy("tid", "start").agg(*[F.first(x).alias(x) for x in ("copies", "body", "a", "lo", "hi")])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the row of each."""
    return np.asarray(column.flatten()).astype(np.int64), np.repeat(np.arange(len(column)), np.asarray(column.value_lengths()))


def _symbols(regions: DataFrame, length: int) -> DataFrame:
    """(seq, i, c, kind, r, p1, p2, size, own) of every anchor: the code behind it and the code of all bytes of its windows.
    Symbols that follow on equal ones are one symbol with these; where one begins, r is its place, p1 and p2 are 128 bits of
    its bytes, size is theirs, and own the size over which it is repeated in itself, if windows lie there."""
    names = ["seq", "i", "c", "kind", "r", "p1", "p2", "size", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = b.column(1).to_pylist()
            data, sizes = np.frombuffer(b"".join(bodies), np.uint8), np.array([len(x) for x in bodies], np.int64)
            ends = np.cumsum(sizes)
            base = ends - sizes
            (a, of), (lo, _), (hi, _) = (_flat(b.column(k)) for k in (2, 3, 4))
            first = np.searchsorted(of, np.arange(len(b)))
            s = a + base[of]
            e = np.append(s[1:], 0)
            e[np.append(first[1:], len(s)) - 1] = ends
            c = code(data, s, s + length - length // 2 + 1)
            kind = mix(code(data, lo + base[of], hi + base[of] + length).view(np.uint64) + (a - lo).astype(np.uint64) * STEP, 9).view(np.int64)
            head, (p1, p2) = np.ones(len(s), bool), (code(data, s, e, v) for v in (EXACT, _OTHER))
            head[1:] = (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1]) | (of[1:] != of[:-1])
            at = np.flatnonzero(head)
            stop = e[np.append(at[1:], len(s))[: len(at)] - 1]
            unit, size = (e - s)[at], stop - s[at]
            place = np.cumsum(head) - 1
            columns = [pa.array(x) for x in (np.asarray(b.column(0))[of], np.arange(len(of)) - first[of], c, kind)]
            for x in (place[at] - place[first][of[at]], code(data, s[at], stop), code(data, s[at], stop, _OTHER), size, np.where((size > unit) & (size >= length + unit), size, 0)):
                full = np.zeros(len(s), np.int64)
                full[at] = x
                columns.append(pa.array(full, mask=~head))
            yield pa.record_batch(columns, names)

    return map_arrow(regions.select("seq", "body", "a", "lo", "hi"), run, ", ".join(f"{n} long" for n in names))


def _sorted(rows: DataFrame, scratch: Scratch, order: list[str], flag: str | None = None) -> DataFrame:
    """Adds pos (from 0, in the order given) and flagged, the number of earlier rows with ``flag``.  A row's place in its sorted
    range is counted where it is sorted; only the sizes of ranges are summed up in order."""
    rows = rows.withColumn("__flag", F.lit(False) if flag is None else F.col(flag))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, held = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            own, n = np.asarray(b.column(b.num_columns - 1).cast(pa.int8())).astype(np.int64), len(b)
            total = held + np.cumsum(own)
            columns = [*b.columns[:-1], pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n)), pa.array(total - own), pa.array(total)]
            yield pa.record_batch(columns, [*b.schema.names[:-1], "part", "local", "f_local", "f_through"])
            at, held = at + n, int(total[-1]) if n else held

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__flag").schema.fields)
    ranged = map_arrow(rows.repartitionByRange(*order).sortWithinPartitions(*order), run, f"{kinds}, part long, local long, f_local long, f_through long")
    ranged = scratch.keep(ranged, "ranged")
    upto = W.partitionBy("all").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = ranged.groupBy("part").agg((F.max("local") + 1).alias("m"), F.max("f_through").alias("f")).withColumn("all", F.lit(0))
    counts = counts.select("part", F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("before"), F.coalesce(F.sum("f").over(upto), F.lit(0)).alias("f_before"))
    d = ranged.join(if_small(scratch.keep(counts, "ranges")), "part")
    return d.withColumns({"pos": F.col("before") + F.col("local"), "flagged": F.col("f_before") + F.col("f_local")}).drop("part", "local", "f_local", "f_through", "before", "f_before")


def suffix_order(symbols: DataFrame, reach: int, scratch: Scratch, spare: float = 0.0) -> DataFrame:
    """(seq, i, at) of (seq, i, sym, size): ``at`` ascends as the suffixes of all strings do, whose symbols are positive
    numbers.  A string's end comes before every symbol; equal suffixes, and those that agree over ``reach`` in size, are
    in any order.  The recursion ends where no more than the share ``spare`` of the sampled suffixes is left to be told
    apart; those are in any order, too."""
    follow = W.partitionBy("seq").orderBy("i")
    place = F.col("i") % 3
    own = symbols.withColumns({f"s{k}": F.lead("sym", k, 0).over(follow) for k in (1, 2)} | {"span": F.col("size") + F.lead("size", 1, 0).over(follow) + F.lead("size", 2, 0).over(follow)})
    before = set(scratch.paths)
    own = scratch.keep(own.drop("size"), "suffixes")
    sample, triple = own.where(place != 0), ["sym", "s1", "s2"]
    names = sample.groupBy(*triple).agg(F.count("*").alias("times"), F.max((F.col("s2") != 0) & (F.col("span") < reach)).alias("short"))
    names = scratch.keep(names, "names")
    counted = names.agg(F.sum("times").alias("all"), F.sum(F.when(F.col("short") & (F.col("times") > 1), F.col("times")).otherwise(0)).alias("left")).first()
    if (counted["left"] or 0) <= spare * (counted["all"] or 0):
        ranks = _sorted(sample.select(*triple, "seq", "i"), scratch, [*triple, "seq", "i"]).select("seq", "i", (F.col("pos") + 1).alias("at"))
    else:
        names = names.select(*triple).repartitionByRange(*triple).sortWithinPartitions(*triple).withColumn("name", F.monotonically_increasing_id() + 1)
        names = scratch.keep(names, "numbers")
        again = sample.join(names, triple).select((F.col("seq") * 2 + place - 1).alias("seq"), F.floor(F.col("i") / 3).alias("i"), F.col("name").alias("sym"), F.col("span").alias("size"))
        inner = suffix_order(again, reach, scratch, spare)
        ranks = inner.select(F.floor(F.col("seq") / 2).alias("seq"), (F.col("i") * 3 + F.pmod("seq", F.lit(2)) + 1).alias("i"), "at")
    ranks = scratch.keep(ranks, "ranks")
    d = own.join(ranks, ["seq", "i"], "left")
    d = d.withColumns({f"r{k}": F.coalesce(F.lead("at", k).over(follow), F.lit(0)) for k in (1, 2)}).withColumn("rest", place == 0)
    d = scratch.keep(d.drop("s2", "span"), "merging")
    rest = F.col("rest")
    one = _sorted(d.where(place != 2).drop("s1", "r2"), scratch, ["sym", "r1", "seq", "i"], "rest")
    two = _sorted(d.where(place != 1).drop("r1"), scratch, ["sym", "s1", "r2", "seq", "i"], "rest")
    both = one.where(rest).select("seq", "i", "pos").union(two.where(rest).select("seq", "i", F.col("pos") - F.col("flagged")))
    merged = both.groupBy("seq", "i").agg((F.sum("pos") + 1).alias("at"))
    for x in (one, two):
        merged = merged.union(x.where(~rest).select("seq", "i", F.col("at") + F.col("flagged")))
    done = scratch.keep(merged, "order")
    scratch.drop(*(kept for k, (kept, _) in list(scratch.paths.items()) if k not in before and kept is not done))
    return done


def common_sizes(heads: np.ndarray, sizes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The size of the symbols that each suffix and the one after it begin with; heads are one after another."""
    n = np.diff(offsets)
    both, total = np.minimum(n[:-1], n[1:]), np.zeros(max(len(n) - 1, 0), np.int64)
    alive = np.arange(len(total))
    step = 0
    while len(alive := alive[both[alive] > step]):
        x = offsets[alive] + step
        alive = alive[heads[x] == heads[offsets[alive + 1] + step]]
        total[alive] += sizes[offsets[alive] + step]
        step += 1
    return total


def _longest(strings: DataFrame, order: DataFrame, length: int, reach: int) -> DataFrame:
    """(seq, i, common) of suffixes that have ``length`` bytes or more in common with an adjacent one; i: the anchor.  Suffixes
    lie in sorted ranges and are compared inside them; what meets at two ranges' edge is left to the windows' codes."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (syms, of), (sizes, _) = _flat(b.column(1)), _flat(b.column(2))
            if not len(of):
                continue
            ends = np.cumsum(sizes)
            row_end = np.searchsorted(of, of, side="right")
            stop = np.minimum(np.searchsorted(ends, ends - sizes + reach) + 1, row_end)
            n = stop - np.arange(len(of))
            cuts = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(np.arange(len(of)) - cuts[:-1], n) + np.arange(cuts[-1])
            yield pa.record_batch([pa.array(np.asarray(b.column(0))[of]), b.column(4).flatten(), *_lists(cuts, (syms[at], pa.int64()), (sizes[at], pa.int32())), b.column(3).flatten()], ["seq", "i", "head", "sizes", "at"])

    strings = strings.join(order, ["seq", "i"]).groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("i", "sym", "size", "at", "anchor"))).alias("s"))
    strings = strings.select("seq", F.col("s.sym").alias("syms"), F.col("s.size").cast("array<int>").alias("sizes"), F.col("s.at").cast("array<long>").alias("at"), F.col("s.anchor").alias("anchor"))
    rows = map_arrow(strings, heads, "seq long, i long, head array<long>, sizes array<int>, at long")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last suffix of the batch before, not yet given out
        for b in batches:
            if not len(b):
                continue
            b = b if last is None else pa.concat_batches([last, b])
            (head, _), (sizes, _) = _flat(b.column(2)), _flat(b.column(3))
            offsets = np.concatenate([[0], np.cumsum(np.asarray(b.column(2).value_lengths()))])
            both = common_sizes(head, sizes, offsets)
            near = np.maximum(np.append(both, 0), np.append(0, both))
            keep = np.flatnonzero(near >= length)
            yield pa.record_batch([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep)), pa.array(near[keep])], ["seq", "i", "common"])
            last = b.slice(len(b) - 1)

    ordered = rows.repartitionByRange("at", "seq", "i").sortWithinPartitions("at", "seq", "i")
    found = map_arrow(ordered.select("seq", "i", "head", "sizes"), compare, "seq long, i long, common long")
    return found.groupBy("seq", "i").agg(F.max("common").alias("common"))


def _pairs(mask: np.ndarray, base: np.ndarray) -> pa.Array:
    """Begins and ends of the runs of true values, one after another, in a list for each stretch that begins at ``base``; a
    false value lies between stretches."""
    at = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
    of = np.searchsorted(base, at, side="right") - 1
    return _lists(np.searchsorted(of, np.arange(len(base) + 1)), (at - base[of], pa.int32()))[0]


def _covered(regions: DataFrame, common: DataFrame, length: int) -> DataFrame:
    """(seq, tid, start, done, open, i): runs of windows that common prefixes cover, runs of the others, and the symbols
    that have some of those.  Windows of a text that occurs twice are all covered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            (a, of), (lo, _), (hi, _), (i, i_of), (n, _) = (_flat(b.column(k)) for k in range(4, 9))
            first = np.searchsorted(of, np.arange(len(b) + 1))
            size = hi[first[1:] - 1] + 1
            base = np.cumsum(size + 1) - (size + 1)
            real = np.ones(int(size.sum()) + len(b), bool)
            real[base + size] = False
            change = np.zeros(len(real) + 1, np.int64)
            x = base[i_of] + a[first[i_of] + i]
            np.add.at(change, x, 1)
            np.add.at(change, x + n - length + 1, -1)
            mask = (np.cumsum(change[:-1]) > 0) | np.repeat(np.asarray(b.column(2)) > 1, size + 1)
            left = real & ~mask
            sums = np.concatenate([[0], np.cumsum(left)])
            some = np.flatnonzero(sums[base[of] + hi + 1] > sums[base[of] + lo])
            cuts = np.searchsorted(some, first)
            yield pa.record_batch([b.column(0), b.column(1), b.column(3), _pairs(mask & real, base), _pairs(left, base), *_lists(cuts, (some - first[of[some]], pa.int32()))], ["seq", "tid", "start", "done", "open", "i"])

    each = common.where(F.col("common") >= length).groupBy("seq").agg(F.collect_list(F.struct("i", "common")).alias("x"))
    d = regions.select("seq", "tid", "copies", "start", "a", "lo", "hi").join(each, "seq", "left")
    none = F.array().cast("array<long>")
    d = d.select("seq", "tid", "copies", "start", "a", "lo", "hi", F.coalesce("x.i", none).alias("i"), F.coalesce("x.common", none).alias("common"))
    return map_arrow(d, run, "seq long, tid long, start long, done array<int>, open array<int>, i array<int>")


def _slices(regions: DataFrame, covered: DataFrame, targets: DataFrame, length: int) -> DataFrame:
    """(k, u1, u2, seq, b, e, open): for SLICE neighbouring windows before an anchor the code of the bytes that all
    of them have, 128 bits of the bytes that any of them has, and where these begin and end; of symbols with windows that
    aren't covered, and of the targets."""
    known = covered.select("seq", "i").join(targets.groupBy("seq").agg(F.collect_list("i").alias("wanted")), "seq", "left").where("size(i) > 0 or wanted is not null")
    names = ["k", "u1", "u2", "seq", "b", "e", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            bodies = batch.column(1).to_pylist()
            ends = np.cumsum([len(x) for x in bodies])
            base, data = ends - [len(x) for x in bodies], np.frombuffer(b"".join(bodies), np.uint8)
            (a, of), (lo, _), (hi, _) = (_flat(batch.column(k)) for k in (2, 3, 4))
            first, (partly, p_of), (wanted, w_of) = np.searchsorted(of, np.arange(len(batch))), _flat(batch.column(5)), _flat(batch.column(6))
            left = first[p_of] + partly
            x = np.unique(np.concatenate([left, first[w_of] + wanted]))
            near, far = (a[x] - hi[x]) // SLICE, (a[x] - lo[x]) // SLICE
            n = far - near + 1
            x = np.repeat(x, n)
            part = np.repeat(far + np.cumsum(n) - n, n) - np.arange(n.sum())
            s = a[x] - SLICE * part
            begin, last = np.maximum(s - SLICE + 1, lo[x]), np.minimum(s, hi[x])
            own = base[of[x]]
            at, k = np.argsort(own + s, kind="stable"), np.zeros(len(s), np.int64)
            k[at] = code(data, (own + s)[at], (own + s)[at] + length - SLICE + 1)
            k = mix(k.view(np.uint64) + part.astype(np.uint64) * STEP, 11).view(np.int64)
            place = ((a[x] - begin) * length + (a[x] - last)).astype(np.uint64) * STEP
            u1, u2 = (mix(code(data, own + begin, own + last + length, v).view(np.uint64) + place, 13).view(np.int64) for v in (EXACT, _OTHER))
            columns = [k, u1, u2, np.asarray(batch.column(0))[of[x]], begin, last + length, np.isin(x, left)]
            yield pa.record_batch([pa.array(c) for c in columns], names)

    d = regions.select("seq", "body", "a", "lo", "hi").join(known, "seq").select("seq", "body", "a", "lo", "hi", "i", F.coalesce("wanted", F.array().cast("array<int>")).alias("wanted"))
    return map_arrow(d, run, ", ".join(f"{n} {'boolean' if n == 'open' else 'long'}" for n in names))


def _windows(regions: DataFrame, covered: DataFrame, slices: DataFrame, length: int) -> DataFrame:
    """(w1, w2, seq, p, open) of the windows in the slices; open: in an open slice, and no common prefix covers the window."""
    lists = [F.collect_list(F.col(c).cast("int")).alias(c) for c in ("b", "e", "open")]
    known = slices.groupBy("seq").agg(*lists).join(covered.select("seq", F.col("open").alias("left")), "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            bodies = batch.column(1).to_pylist()
            sizes = np.array([len(x) for x in bodies], np.int64)
            base, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(bodies), np.uint8)
            (b, of), (e, _), (own, _), (left, l_of) = (_flat(batch.column(k)) for k in range(2, 6))
            n = e - b  # the bytes of each slice, one slice after another
            s = np.cumsum(n) - n
            data = data[np.repeat(base[of] + b - s, n) + np.arange(n.sum())]
            n = n - length + 1
            x = np.repeat(np.arange(len(b)), n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at, p, seq = s[x] + nth, b[x] + nth, np.asarray(batch.column(0))[of[x]]
            todo = (own[x] == 1) & (np.searchsorted(base[l_of] + left, base[of[x]] + p, side="right") % 2 == 1)
            columns = [*(code(data, at, at + length, v) for v in (EXACT, _OTHER)), seq, p, todo]
            yield pa.record_batch([pa.array(c) for c in columns], ["w1", "w2", "seq", "p", "open"])

    d = regions.select("seq", "body").join(known, "seq").select("seq", "body", "b", "e", "open", "left")
    return map_arrow(d, run, "w1 long, w2 long, seq long, p long, open boolean")


def _spans(rows: DataFrame) -> DataFrame:
    """(tid, begins, ends) of the union of each text's spans."""

    def join(text: dict[str, list]) -> Iterator[tuple]:
        begins, ends = [], []
        for s, e in zip(text["s"], text["e"], strict=True):
            if ends and s <= ends[-1]:
                ends[-1] = max(ends[-1], e)
            else:
                begins.append(s)
                ends.append(e)
        yield text["tid"][0], begins, ends

    return grouped(rows, ["tid"], ["s"], join, "tid long, begins array<int>, ends array<int>")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (row, doc_id, t1, t2, n_bytes, whole), texts (t1, t2, tid, copies) and spans (tid, begins, ends) of texts that
    occur once: the bytes that strings of ``length`` which start elsewhere too cover."""
    scratch = Scratch(docs.sparkSession, tidy=True)
    filed = scratch.keep(_anchored(docs, length), "anchored")
    info = scratch.keep(filed.select("row", "doc_id", "t1", "t2", "n_bytes", "whole"), "info")
    texts = info.groupBy("t1", "t2").agg(F.min("row").alias("tid"), F.min_by("doc_id", "row").alias("__doc"), F.count("*").alias("copies"))
    texts = scratch.keep(texts, "texts")
    found = _candidates(filed.join(if_small(texts.select(F.col("tid").alias("row"))), "row", "left_semi"))
    wanted = texts.select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), "__doc", "tid", "copies")
    candidates = scratch.keep(found.join(wanted, "tid"), "candidates")
    scratch.drop(filed)
    repeated = not info.groupBy("t1", "t2", "doc_id").count().where("count > 1").isEmpty()
    regions = scratch.keep(_regions(_named(docs), candidates, repeated, length).withColumn("seq", F.monotonically_increasing_id()), "regions")
    symbols = scratch.keep(_symbols(regions, length), "symbols")
    heads = symbols.where("r is not null")
    names = scratch.keep(heads.select("p1", "p2").distinct().withColumn("sym", F.monotonically_increasing_id() + 1), "names")
    strings = heads.join(names, ["p1", "p2"]).select("seq", F.col("r").alias("i"), "sym", "size", F.col("i").alias("anchor"))
    strings = scratch.keep(strings, "strings")
    scratch.drop(candidates, names)
    order = suffix_order(strings.drop("anchor"), length, scratch, SPARE)
    common = _longest(strings, order, length, length + length // 2).union(heads.where("own > 0").select("seq", "i", "own"))
    covered = scratch.keep(_covered(regions, common, length), "covered")
    left = covered.select("seq", F.explode("i").alias("i")).select("seq", F.col("i").cast("long").alias("i"))
    behind = scratch.keep(symbols.join(left, ["seq", "i"]).select("c").distinct(), "behind")
    closed = symbols.join(left, ["seq", "i"], "left_anti").join(behind, "c")
    targets = closed.groupBy("kind").agg(F.min(F.struct("seq", "i")).alias("x")).select("x.seq", F.col("x.i").cast("int").alias("i"))
    every = scratch.keep(_marked(_slices(regions, covered, targets, length), ["u1", "u2"]).drop("u1", "u2"), "slices")
    scratch.drop(symbols, strings, order, behind)
    settled = every.where("open and again").select("seq", "b", "e")
    each = every.where("first").withColumn("open", F.col("open") & ~F.col("again"))
    recur = each.groupBy("k").agg(F.count("*").alias("n"), F.max("open").alias("some")).where("n > 1 and some").select("k")
    windows = _marked(_windows(regions, covered, each.join(recur, "k").select("seq", "b", "e", "open"), length), ["w1", "w2"], only=True)
    more = windows.where("open").select("seq", F.col("p").alias("b"), (F.col("p") + length).alias("e")).union(settled)
    more = more.join(covered.select("seq", "tid", "start"), "seq").select("tid", (F.col("start") + F.col("b")).alias("s"), (F.col("start") + F.col("e")).alias("e"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("done") / 2).cast("int") - 1), lambda k: F.struct(F.get("done", 2 * k).alias("x"), F.get("done", 2 * k + 1).alias("y")))
    done = covered.where("size(done) > 0").select("tid", "start", F.explode(pairs).alias("r")).select("tid", (F.col("start") + F.col("r.x")).alias("s"), (F.col("start") + F.col("r.y") + length - 1).alias("e"))
    single = if_small(texts.where("copies = 1").select("tid"))
    spans = scratch.keep(_spans(more.union(done).join(single, "tid", "left_semi")), "spans")
    scratch.drop(regions, covered, every)
    return info, texts, spans


def removed_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row after its repeated bytes are gone.

    Null and empty texts have no bytes; texts shorter than ``length`` stay whole; rows with one text are copies of each
    other, so that nothing of them is left if they are long enough; an empty table gives no rows; a null or repeated
    doc_id and other columns don't matter.
    """
    info, texts, spans = repeated_spans(docs, length)
    known = texts.select("t1", "t2", "tid", "copies").join(spans.select("tid", "begins", "ends"), "tid", "left")
    none = hashlib.sha256(b"").hexdigest()
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    rows = info.join(texts.select("t1", "t2", "tid", "copies"), ["t1", "t2"]).join(spans.select("tid", F.lit(True).alias("cut")), "tid", "left")
    whole = rows.where("cut is null").select("doc_id", "n_bytes", F.when(copied, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(copied, 1).otherwise(0).cast("long").alias("n_spans"), F.when(copied, none).otherwise(F.col("whole")).alias("kept_sha256"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, raw, begins, ends in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                kept = b"".join(raw[x:y] for x, y in zip([0, *ends], [*begins, len(raw)], strict=True))
                out.append((doc_id, len(raw), len(raw) - len(kept), len(begins), hashlib.sha256(kept).hexdigest()))
            if out:
                yield pa.record_batch([pa.array(list(v), pa.string() if k == 4 else pa.int64()) for k, v in enumerate(zip(*out, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    held: Column | int = spans.agg(F.sum(F.size("begins"))).first()[0] or 0
    few = known.where("begins is not null").select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), "begins", "ends")
    few = F.broadcast(few) if held <= 500_000 else few  # 8 MB of spans at most
    own = _named(docs)
    cut_rows = own.join(few, (own["t1"] == F.col("__t1")) & (own["t2"] == F.col("__t2"))).select("doc_id", "text", "begins", "ends")
    return whole.union(map_arrow(cut_rows, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
