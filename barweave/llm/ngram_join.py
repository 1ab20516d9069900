"""Exact Jaccard self-join of documents on word shingles with a token-group matrix.

1. Rows of one shingle set are one set, whatever their doc_ids; a set is a node.
2. Sets that agree in two of three min-hashes meet in parts of bounded size; what an exact comparison links there is
   one component so far.  In every part of a hot sketch sits the same anchor, so that a large cluster of near copies
   becomes one component at linear cost.  Components, and crowds of single sets that share a token and have about the
   same size, are partitioned into groups of bounded size.
3. The token-group matrix is kept as rows (token, group): a group is filed under the union of its members' prefixes,
   where shingles are ordered by rarity (counted over all documents in bounded hashed counts; any one order that all
   sets share gives the same links).  A set x has a prefix of |x| - ceil(t|x|) + 1 shingles; sets with J >= t share one.
4. Sets are queries against groups with sets of other components.  Common prefix tokens, summed over the matrix, bound a query's
   overlap with every member of a group; only groups whose bound reaches the threshold are opened, and their members
   are compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, Scratch, if_small, map_arrow
from .shingles import distinct, mix, shingle_codes, shingle_sets, slabs, word_codes

#: Sets and shingles of a part or of a block of queries, on average.
PART, PART_SHINGLES = 128, 200_000
#: So many single sets under one token are put into groups.
CROWD = 8
#: Hashed counts of shingles, added up in ranges: their number is fixed, so is what the driver gets and sends (16 MB each).
COUNT_BITS, COUNT_RANGES = 22, 64
#: Token columns compared at once.
COLUMNS = 4096
#: Slots of tokens, 64 to a row, that are handed to every task in place of many tokens (2^19 rows at most).
SLOT_BITS = 25
#: Pairs of the three min-hashes under which sets meet.
SKETCHES = ("k12", "k13", "k23")


def _rarity(docs: DataFrame, shingle: int) -> np.ndarray:
    """For each hashed count its place in ascending order: the rarer a shingle's count, the smaller."""
    size = (1 << COUNT_BITS) // COUNT_RANGES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.uint32)
        for b in batches:
            for data, offsets in slabs(b.column(0)):
                codes, _ = shingle_codes(*word_codes(data, offsets), shingle)
                np.add.at(total, (codes >> np.uint64(64 - COUNT_BITS)).astype(np.int64), np.uint32(1))
        if total.any():  # most counts are small, so their high bytes compress away
            packed = [pa.compress(total[k * size : (k + 1) * size].view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True) for k in range(COUNT_RANGES)]
            yield pa.record_batch([pa.array(np.arange(COUNT_RANGES, dtype=np.int32)), pa.array(packed, pa.binary())], ["k", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for k, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(pa.decompress(packed, 4 * size, "zstd", asbytes=True), np.uint8).reshape(4, size)
                totals[k] = totals.get(k, 0) + np.ascontiguousarray(raw.T).view(np.uint32)[:, 0].astype(np.int64)
        yield pa.record_batch([pa.array(list(totals), pa.int32()), pa.array([np.minimum(t, 0xFFFFFFFF).astype(np.uint32).tobytes() for t in totals.values()], pa.binary())], ["k", "counts"])

    schema = "k int, counts binary"
    total = np.zeros((COUNT_RANGES, size), np.uint32)
    for k, counts in map_arrow(map_arrow(docs.select("text"), count, schema).repartition("k"), add, schema).collect():
        total[k] = np.frombuffer(counts, np.uint32)
    place = np.empty(total.size, np.uint32)
    place[np.argsort(total.reshape(-1), kind="stable")] = np.arange(total.size, dtype=np.uint32)
    return place


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n + (-n * percent) // 100 + 1


def _file(docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Each row's set: size, fingerprint (a, b), sketches and prefix; ``row`` names the row, ``hash`` its text."""
    spark = docs.sparkSession
    place = spark.sparkContext.broadcast(_rarity(docs, shingle))
    schema = "row long, doc_id long, hash long, n_shingles long, a long, b long, k12 long, k13 long, k23 long, prefix array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, low = TaskContext.get().partitionId() << 40, np.uint64((1 << (64 - COUNT_BITS)) - 1)
        for batch in batches:
            at = 0
            for data, offsets in slabs(batch.column(2)):
                codes, starts = shingle_codes(*word_codes(data, offsets), shingle)
                # the place of its count takes the place of a code's high bits: still one number for each shingle
                codes = (place.value[(codes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(64 - COUNT_BITS)) | (codes & low)
                codes, starts = distinct(codes, starts)
                n = np.diff(starts)
                some = np.flatnonzero(n)
                heads = starts[:-1][some]

                def over(reduce: np.ufunc, salt: int, codes=codes, heads=heads, some=some, n=n) -> np.ndarray:
                    out = np.zeros(len(n), np.uint64)
                    if len(some):
                        out[some] = reduce.reduceat(mix(codes, salt), heads)
                    return out

                h = [over(np.minimum, k) for k in (1, 2, 3)]
                keys = [mix(h[i] * np.uint64(0x9E3779B97F4A7C15) + h[j], 10 * i + j) for i, j in ((0, 1), (0, 2), (1, 2))]
                taken = np.where(n > 0, prefix_length(n, percent), 0)
                ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(taken)])
                picked = codes[np.repeat(starts[:-1] - ends[:-1], taken) + np.arange(ends[-1])]
                numbers = [over(np.add, 0xA), over(np.add, 0xB), *keys]
                columns = [pa.array(row + np.arange(len(n))), *(batch.column(k).slice(at, len(n)) for k in (0, 1)), pa.array(n), *(pa.array(x.view(np.int64)) for x in numbers)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(picked.view(np.int64)))
                yield pa.record_batch([*columns, lists], ["row", "doc_id", "hash", "n_shingles", "a", "b", "k12", "k13", "k23", "prefix"])
                at, row = at + len(n), row + len(n)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text"), run, schema)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by dense slabs of the columns both have."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.int64)

    def place(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        hit = common[at] == flat
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]

    if len(common):
        (ra, ca), (rb, cb) = place(left, a), place(right, b)
        for at in range(0, len(common), COLUMNS):
            width = min(COLUMNS, len(common) - at)
            x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
            for m, rows, columns in ((x, ra, ca), (y, rb, cb)):
                own = (columns >= at) & (columns < at + width)
                m[rows[own], columns[own] - at] = 1
            out += np.rint(x @ y.T).astype(np.int64)
    return out


def similar(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    both = overlaps(left, right)
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    return (100 * both >= percent * (sizes - both)) & (both > 0)


def group_part(nodes: list[int], sets: list[np.ndarray], anchor: int | None, percent: int) -> list[tuple[int, int]]:
    """(node, head) for the nodes of a part that something links: its component's anchor, or the member with the most
    links (ties: the first)."""
    link = similar(sets, sets, percent)
    order, head = np.argsort(-link.sum(axis=1), kind="stable"), {}
    if anchor in nodes:
        order = np.concatenate([[nodes.index(anchor)], order])
    out = []
    for i in order.tolist():
        if i in head:
            continue
        reached, new = np.zeros(len(sets), bool), np.zeros(len(sets), bool)
        new[i] = True
        while new.any():
            reached |= new
            new = link[new].any(axis=0) & ~reached
        own = np.flatnonzero(reached).tolist()
        head.update((j, i) for j in own)
        if len(own) > 1:
            out += [(nodes[j], nodes[i]) for j in own]
    return out


def blocks(rows: DataFrame, key: list[str], fn: Callable[[dict[str, list]], list[tuple]], schema: str) -> DataFrame:
    """``fn`` over the rows of each key, which are few; many keys share a task and none is a call of its own."""
    names, types = rows.columns, [f.split() for f in schema.split(",")]
    out = pa.schema([(n, pa.int64()) for n, _ in types])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {n: [] for n in names}
        of, found = None, []
        for b in batches:
            columns = [b.column(i) for i in range(len(names))]
            keys = list(zip(*(c.to_pylist() for n, c in zip(names, columns, strict=True) if n in key), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if of not in (None, keys[i]):
                    found += fn(held)
                    held = {n: [] for n in names}
                of = keys[i]
                for n, c in zip(names, columns, strict=True):
                    held[n] += c.slice(i, j - i).to_pylist()
            if found:
                yield pa.record_batch([pa.array(list(c), pa.int64()) for c in zip(*found, strict=True)], schema=out)
                found = []
        if of is not None and (found := fn(held)):
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in zip(*found, strict=True)], schema=out)

    return map_arrow(rows.repartition(*key).sortWithinPartitions(*key, "node"), run, schema)


def _one_each(docs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text, hash) of documents, once for each doc_id and text."""
    names = ["__doc", "__hash"]
    again = scratch.keep(rows.groupBy("doc_id", "hash").count().where("count > 1").select("doc_id", "hash").toDF(*names), "again")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    if again.isEmpty():
        return own
    same = own["hash"].eqNullSafe(F.col("__hash")) & own["doc_id"].eqNullSafe(F.col("__doc"))
    again = if_small(again)
    one = scratch.keep(own.join(again, same, "left_semi").dropDuplicates(["doc_id", "hash"]), "one")
    return own.join(again, same, "left_anti").union(one)


def _with_texts(own: DataFrame, sets: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (numbers, one of them a node) with the texts of their nodes.  Few rows are handed to every task, so that a
    text moves only to where it is compared; beyond that all documents are shuffled once."""
    placed = rows.join(sets.select("node", F.col("doc_id").alias("__doc"), F.col("hash").alias("__hash")), "node")
    placed = if_small(scratch.keep(placed, "placed"))
    same = own["hash"].eqNullSafe(F.col("__hash")) & own["doc_id"].eqNullSafe(F.col("__doc"))
    return own.join(placed, same).select(*rows.columns, "text")


def _merged(own: DataFrame, sets: DataFrame, labels: DataFrame | None, key: str, percent: int, shingle: int, scratch: Scratch) -> DataFrame:
    """(node, head): heads of components, or single sets, that agree in a sketch are linked part by part."""
    heads = sets.select("node", F.col(key).alias("key"), "n_shingles", F.lit(1).cast("long").alias("weight"))
    if labels is not None:
        weights = labels.groupBy("head").agg(F.count("*").alias("w"))
        heads = heads.drop("weight").join(labels.where("node <> head").select("node"), "node", "left_anti")
        heads = heads.join(weights.withColumnRenamed("head", "node"), "node", "left").withColumn("weight", F.coalesce("w", F.lit(1))).drop("w")
    met = heads.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), F.max_by("node", F.struct("weight", "node")).alias("anchor")).where("n > 1")
    parts = F.greatest(F.ceil(F.col("n") / PART), F.ceil(F.col("s") / PART_SHINGLES)).cast("long")
    dealt = heads.join(met, "key").select("key", F.pmod(F.xxhash64("node"), parts).alias("part"), "node", "anchor")
    dealt = scratch.keep(dealt, "dealt")
    anchors = dealt.groupBy("key", "part").agg(F.first("anchor").alias("anchor")).select("key", "part", F.col("anchor").alias("node"), "anchor")
    rows = dealt.where("node <> anchor").union(anchors)
    rows = _with_texts(own, sets, rows, scratch).select("key", "part", "node", "anchor", "text")

    def link(part: dict[str, list]) -> list[tuple]:
        if len(part["node"]) < 2:
            return []
        return group_part(part["node"], shingle_sets(pa.array(part["text"]), shingle), part["anchor"][0], percent)

    linked = scratch.keep(blocks(rows, ["key", "part"], link, "node long, head long").distinct(), "linked")
    scratch.drop(dealt)
    return linked


def _followed(labels: DataFrame | None, linked: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels after heads were linked to other heads."""
    if labels is None:
        return linked
    moved = linked.select(F.col("node").alias("head"), F.col("head").alias("to"))
    old = labels.join(moved, "head", "left").select("node", F.coalesce("to", "head").alias("head"))
    new = scratch.keep(old.union(linked.join(labels.select("node"), "node", "left_anti")), "labels")
    scratch.drop(labels, linked)
    return new


def need(n: Column, m: Column, percent: int) -> Column:
    """Common prefix tokens that sets of n and m shingles have at least if they link."""
    overlap = F.ceil((n + m) * percent / (100 + percent))
    rest = F.ceil(F.greatest(n, m) * percent / 100) - 1
    return F.greatest(overlap - rest, F.lit(1))


def least_need(n: Column, lowest: Column, highest: Column, percent: int) -> Column:
    """A lower bound of ``need(n, m)`` over all sizes m from lowest to highest.

    Up to n it rises with m, so its least value stands at the lowest size.  Beyond n, overlap less rest falls but for
    rounding: both are rounded up, so no value is more than one below the value at the highest size.
    """
    right = need(n, highest, percent) - F.when(highest > F.greatest(n, lowest), 1).otherwise(0)
    return F.greatest(F.least(need(n, lowest, percent), right), F.lit(1))


def _groups(own: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(node, group): components, and crowds of single sets that have a token and about their size in common, are cut
    into groups of about PART sets; a group is named by its smallest node.  What isn't named is a group of its own."""
    crowd = shared.where(F.col("singles") >= CROWD).join(own.where("of.weight = 1").select("node", "n_shingles"), "node")
    crowd = crowd.groupBy("node", "n_shingles").agg(F.max_by("token", F.struct("singles", "token")).alias("key"))
    classes = F.floor(F.log("n_shingles") / F.log(F.lit(100 / percent))).cast("long")
    crowd = crowd.select("node", "n_shingles", "key", classes.alias("class"))
    linked = own.where("of.weight > 1").select("node", "n_shingles", F.col("of.head").alias("key"), F.lit(-1).cast("long").alias("class"))
    every = linked.union(crowd)
    sizes = every.groupBy("key", "class").agg(F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum("n_shingles") / PART_SHINGLES)).cast("long").alias("parts"))
    dealt = every.join(sizes, ["key", "class"]).select("node", "key", "class", F.pmod(F.xxhash64("node"), "parts").alias("part"))
    return dealt.select("node", F.min("node").over(W.partitionBy("key", "class", "part")).alias("group"))


def sifted(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows whose token shares a slot with one of the tokens, so that few of the others are shuffled to be joined; all rows
    where the tokens are few, as these are broadcast themselves."""
    if tokens.count() <= BROADCAST_ROWS:
        return rows
    slot = F.col("token").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    word, place = F.shiftright(slot, 6).alias("word"), F.pmod(slot, F.lit(64)).cast("int").alias("place")
    taken = tokens.select(word, F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = rows.withColumns({"word": word, "place": place}).join(F.broadcast(taken), "word").where(F.getbit("bits", "place") == 1)
    return found.select(*rows.columns)


def qualifying(sets: DataFrame, labels: DataFrame, percent: int, scratch: Scratch, read: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, group, n) pairs that are to be opened, and (node, group) of the sets in groups of several.

    ``labels``: (node, head) of components; what isn't named is alone.  A pair is within the bound of common tokens, and
    the group has a member of another component under one of them.  A set asks for sets of larger components (ties: of
    the larger name) only, so the sets of a large component are asked about, not asking.  ``read``: a written table that
    only ``sets`` reads; it is deleted as soon as it isn't needed.
    """
    sizes = labels.groupBy("head").agg(F.count("*").alias("weight"))
    named = scratch.keep(labels.join(sizes, "head").select("node", "head", "weight"), "named")
    own = sets.select("node", "n_shingles", "prefix").join(if_small(named), "node", "left")
    own = own.select("node", "n_shingles", "prefix", F.struct(F.coalesce("weight", F.lit(1)).alias("weight"), F.coalesce("head", "node").alias("head")).alias("of"))
    own = scratch.keep(own, "own")
    if read is not None:
        scratch.drop(read)
    listed = own.select("node", "of", F.explode("prefix").alias("token"))
    singles = F.count(F.when(F.col("of.weight") == 1, 1)).alias("singles")
    filed = listed.groupBy("token").agg(F.min("of.head").alias("lo"), F.max("of.head").alias("hi"), singles)
    filed = scratch.keep(filed.where("lo <> hi").select("token", "singles"), "filed")
    shared = scratch.keep(sifted(listed.select("token", "node"), filed).join(if_small(filed), "token").select("token", "node", "singles"), "shared")
    groups = scratch.keep(_groups(own, shared, percent), "groups")
    placed = own.join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    matrix = shared.join(placed.select("node", "of", "group"), "node").groupBy("token", "group").agg(F.max("of").alias("of"))
    matrix = scratch.keep(matrix, "matrix")
    largest = matrix.groupBy("token").agg(F.max("of").alias("largest"))
    asked = shared.join(own.select("node", "of", "n_shingles"), "node").join(largest, "token").where("of < largest")
    asked = asked.select("token", "node", F.col("of").alias("q_of"), F.col("n_shingles").alias("n"))
    extent = placed.groupBy("group").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    met = asked.join(matrix.join(extent, "group"), "token").where("q_of < of")
    met = met.where(f"most * 100 >= n * {percent} and least * {percent} <= n * 100")
    n = F.col("n")
    lowest, highest = F.greatest("least", F.ceil(n * percent / 100)), F.least("most", F.floor(n * 100 / percent))
    bound = least_need(n, lowest, highest, percent)
    pairs = met.groupBy("node", "group", "n", "least", "most").agg(F.count("*").alias("common")).where(F.col("common") >= bound)
    pairs = scratch.keep(pairs.select("node", "group", "n"), "pairs")
    scratch.drop(own, named, filed, shared, matrix)
    return pairs, groups


def spanning(found: np.ndarray, left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """As few of the found pairs of left and right nodes as connect the same nodes."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    out = []
    for i, j in zip(*(k.tolist() for k in np.nonzero(found)), strict=True):
        x, y = top(left[i]), top(right[j])
        if x != y:
            root[x] = y
            out.append((left[i], right[j]))
    return out


def _opened(own: DataFrame, sets: DataFrame, groups: DataFrame, pairs: DataFrame, percent: int, shingle: int, scratch: Scratch) -> DataFrame:
    """(x, y): for each qualifying group, links that connect its queries with the members that they link with."""
    sizes = pairs.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / (2 * PART)), F.ceil(F.sum("n") / PART_SHINGLES)).cast("long").alias("blocks"))
    asked = pairs.join(sizes, "group").select("group", F.pmod(F.xxhash64("node"), "blocks").alias("block"), "node", F.lit(True).alias("query"))
    members = groups.join(sizes, "group")
    alone = sizes.join(groups.select("group").distinct(), "group", "left_anti").select("group", F.col("group").alias("node"), "blocks")
    members = members.select("group", "node", "blocks").union(alone).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = asked.union(members.select("group", "block", "node", F.lit(False).alias("query")))
    rows = _with_texts(own, sets, rows, scratch).select("group", "block", "node", "query", "text")

    def link(block: dict[str, list]) -> list[tuple]:
        query = np.array(block["query"])
        if query.all() or not query.any():
            return []
        each, nodes = shingle_sets(pa.array(block["text"]), shingle), block["node"]
        q, m = np.flatnonzero(query).tolist(), np.flatnonzero(~query).tolist()
        return spanning(similar([each[i] for i in q], [each[i] for i in m], percent), [nodes[i] for i in q], [nodes[i] for i in m])

    edges = scratch.keep(blocks(rows, ["group", "block"], link, "x long, y long"), "edges")
    return edges


def connected(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for the nodes of (x, y) edges: root is one node of a connected component.

    Nodes are ordered by a hash, so that chains shrink by a constant factor: each round every node takes its smallest
    neighbour as parent, parents are followed twice, and edges between nodes of one parent are gone.  Rounds end when
    no edge is left; nothing else reaches the driver.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    mark = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id")).alias(c)
    edges = edges.where("x <> y").select(mark("x"), mark("y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    edges = scratch.keep(edges.distinct(), "edges")
    labels = scratch.keep(edges.select(F.explode(F.array("x", "y")).alias("node")).distinct().select("node", F.col("node").alias("root")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("y", "x"))
        parent = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("p"))
        grand = parent.select(F.col("x").alias("p"), F.col("p").alias("g"))
        parent = scratch.keep(parent.join(grand, "p").select("x", F.col("g").alias("p")), "parents")
        moved = labels.join(parent.withColumnRenamed("x", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        px, py = parent.select("x", F.col("p").alias("px")), parent.select(F.col("x").alias("y"), F.col("p").alias("py"))
        left = edges.join(px, "x").join(py, "y").where("px <> py").select(F.least("px", "py").alias("x"), F.greatest("px", "py").alias("y"))
        new = scratch.keep(moved, "labels"), scratch.keep(left.distinct(), "edges")
        scratch.drop(parent, labels, edges)
        labels, edges = new
    return labels.select(F.col("node.id").alias("node"), F.col("root.id").alias("root"))


def _linked(labels: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels after (x, y) edges between sets of different components."""
    head = lambda c: labels.select(F.col("node").alias(c), F.col("head").alias(f"{c}_head"))
    of = edges.join(head("x"), "x", "left").join(head("y"), "y", "left").select(F.coalesce("x_head", "x").alias("x"), F.coalesce("y_head", "y").alias("y"))
    roots = connected(of, scratch)
    new = labels.join(roots.select(F.col("node").alias("head"), "root"), "head", "left").select("node", F.coalesce("root", "head").alias("head"))
    alone = roots.select("node", F.col("root").alias("head")).join(labels.select("node"), "node", "left_anti")
    new = scratch.keep(new.union(alone), "labels")
    scratch.drop(labels, edges)
    return new


def _components(docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(doc_id, hash, n_shingles, a, b, component, least): ``component`` names the component of a row's set and
    ``least`` is the smallest doc_id in it."""
    scratch = Scratch(docs.sparkSession)
    filed = scratch.keep(_file(docs, percent, shingle), "filed")
    rows = scratch.keep(filed.select("row", "doc_id", "hash", "n_shingles", "a", "b"), "rows")
    classes = rows.where("n_shingles > 0").groupBy("a", "b", "n_shingles").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"))
    classes = scratch.keep(classes, "classes")
    every = filed.join(if_small(classes.select(F.col("node").alias("row"))), "row", "left_semi").withColumnRenamed("row", "node")
    sets = scratch.keep(every.select("node", "doc_id", "hash", "n_shingles", *SKETCHES), "sets")

    own = _one_each(docs, rows, scratch)
    labels = None
    for key in SKETCHES:
        labels = _followed(labels, _merged(own, sets, labels, key, percent, shingle, scratch), scratch)
    pairs, groups = qualifying(every, labels, percent, scratch, filed)
    edges = _opened(own, sets, groups, pairs, percent, shingle, scratch)
    scratch.drop(groups, pairs)
    labels = _linked(labels, edges, scratch)
    final = classes.join(labels, "node", "left").select("a", "b", "n_shingles", "least", F.coalesce("head", "node").alias("component"))
    final = scratch.keep(final, "components")
    scratch.drop(sets, labels, classes)
    smallest = final.groupBy("component").agg(F.min("least").alias("least"), F.count("*").alias("sets"))
    final = final.drop("least").join(smallest, "component")
    return rows.drop("row").join(final, ["a", "b", "n_shingles"], "left")


def jaccard_components(docs: DataFrame, percent: int = 90, shingle: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id): components of documents with 100 * intersection >= percent * union.

    Links are between rows: a row with a null doc_id, or with the doc_id of another row, links by its own text.
    component_id is the smallest doc_id of the component, null if it has none.  Null, empty and blank texts have no
    shingles and are alone; repeated rows have one component; an empty table gives no rows; other columns don't matter.
    """
    done = _components(docs, percent, shingle)
    return done.select("doc_id", "n_shingles", F.when(F.col("component").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, percent: int = 90, shingle: int = 3) -> DataFrame:
    """One document of each component stays, with all columns: the one with the smallest doc_id (then the smallest
    fingerprint of its text); rows equal in doc_id and text are one document, of which one row stays.

    Rows without shingles stay.  A component without doc_ids keeps one text.  Names of other columns don't matter.
    """
    scratch = Scratch(docs.sparkSession)
    done = scratch.keep(_components(docs, percent, shingle).where("component is not null").select("doc_id", "hash", "component"), "rows")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")
    kept = done.groupBy("component").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("component", "first")
    ranked = done.join(kept, "component").withColumn("stays", F.col("first") == rank)
    names = ["__doc", "__hash"]
    gone = scratch.keep(ranked.where("not stays").select("doc_id", "hash").distinct().toDF(*names), "copies")
    repeated = scratch.keep(ranked.where("stays").groupBy("doc_id", "hash").count().where("count > 1").select("doc_id", "hash").toDF(*names), "repeated")
    scratch.drop(done)

    def same(of: DataFrame, known: DataFrame) -> Column:
        return F.xxhash64(of["text"]).eqNullSafe(known["__hash"]) & of["doc_id"].cast("long").eqNullSafe(known["__doc"])

    gone = if_small(gone)
    left = docs.join(gone, same(docs, gone), "left_anti")
    if repeated.isEmpty():
        return left
    repeated = if_small(repeated)
    again = left.join(repeated, same(left, repeated), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(repeated, same(left, repeated), "left_anti").union(again)
