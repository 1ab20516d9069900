"""Merkle manifest of a table: one digest for each row, source and dataset, and a proof for each row.

Leaves are numbered within their source by a range sort.  Aligned blocks of ARITY ** HEIGHT leaves are traversed in
postorder, each in one task: a recursive call returns its subtree's digest, and while the calls unwind each leaf gets
the siblings of the subtrees that hold it.  Block roots are the leaves of the next distributed traversal, up to one
root a source; the sources' roots are one more tree.  Going down again, each block gets the siblings above it, so
proofs are whole when its leaves leave the task, and no level's proofs are ever written out but those of block roots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, grouped, if_small, numbered

#: Children of a node, and levels of a block.
ARITY, HEIGHT = 16, 3
BLOCK = ARITY**HEIGHT
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Steps of a proof, from the leaf up: a node's place among its siblings, and their digests one after another.
PATH = "array<struct<at: int, others: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(n: int) -> int:
    """Levels above n leaves until one node is left."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


def traverse(leaves: list[str], height: int) -> tuple[str, list[list[tuple[int, str]]]]:
    """The root of ``height`` levels over the leaves of one block, and each leaf's steps from below."""
    steps: list[list[tuple[int, str]]] = [[] for _ in leaves]

    def visit(at: int, level: int) -> str:
        if level == 0:
            return leaves[at]
        width = ARITY ** (level - 1)
        begins = range(at, min(at + ARITY * width, len(leaves)), width)
        each = [visit(k, level - 1) for k in begins]
        for j, begin in enumerate(begins):
            step = j, "".join(each[:j] + each[j + 1 :])
            for leaf in range(begin, min(begin + width, len(leaves))):
                steps[leaf].append(step)
        return digest("".join(each))

    return visit(0, height), steps


def folded(leaf: str, path: list[tuple[int, str]]) -> str:
    """The root that a leaf and its proof give."""
    for at, others in path:
        cut = at * len(leaf)
        leaf = digest(others[:cut] + leaf + others[cut:])
    return leaf


def field(value: Column) -> Column:
    """A value's UTF-8 byte count, a colon and the value; a hyphen for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256)


def _blocks(nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """Nodes with the block that each lies in, and what is known above the block."""
    d = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))
    return d if above is None else d.join(if_small(above).withColumnRenamed("pos", "block"), ["tree", "block"])


def climbed(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The nodes of each traversal (tree, pos, n, digest), from the given ones to one a tree."""

    def roots(block: dict[str, list]) -> list[tuple]:
        n = block["n"][0]
        root, _ = traverse(block["digest"], min(HEIGHT, levels(n)))
        return [(block["tree"][0], block["block"][0], -(-n // BLOCK), root)]

    out = [nodes]
    while not out[-1].where("n > 1").isEmpty():
        own = _blocks(out[-1].select("tree", "pos", "n", "digest"))
        out.append(scratch.keep(grouped(own, ["tree", "block"], ["pos"], roots, "tree string, pos long, n long, digest string"), "roots"))
    return out


def _steps(path: list[tuple[int, str]]) -> list[dict]:
    return [{"at": at, "others": others} for at, others in path]


def _pairs(path: list[dict]) -> list[tuple[int, str]]:
    return [(s["at"], s["others"]) for s in path]


def paths(rounds: list[DataFrame], above: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, pos, path, subroot, root) of the nodes of the second traversal; ``above`` has the same of the last one's."""

    def down(block: dict[str, list]) -> Iterator[tuple]:
        upper = _pairs(block["path"][0])
        _, steps = traverse(block["digest"], min(HEIGHT, levels(block["n"][0])))
        for pos, own in zip(block["pos"], steps, strict=True):
            yield block["tree"][0], pos, _steps(own + upper), block["subroot"][0], block["root"][0]

    for nodes in rounds[-2:0:-1]:
        rows = _blocks(nodes, above)
        above = scratch.keep(grouped(rows, ["tree", "block"], ["pos"], down, f"tree string, pos long, path {PATH}, subroot string, root string"), "paths")
    return above


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``folded_root`` comes from the row as it would be after its text's A-Z were lowered, where 5 divides the crc32 of
    its doc_id, and from the row as it is elsewhere; ``verified`` says whether it is the root.  Rows of one source and
    doc_id are ordered by their digests (a null doc_id comes first and isn't tampered with); a null source is a source
    of its own; repeated rows have a proof each; an empty table gives no rows; other columns don't matter.
    """
    scratch = Scratch(docs.sparkSession)
    names = ("doc_id", "source", "lang", "n_chars")
    own = [F.col(c) for c in names]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    low = F.when(tampered, leaf_digest(*own, F.translate("text", UPPER, LOWER)))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # null comes first
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(*own, F.col("text")).alias("digest"), low.alias("tampered"), F.monotonically_increasing_id().alias("tie"))
    leaves = scratch.keep(numbered(rows, scratch, ["doc_id", "digest", "tie"]).drop("tie"), "leaves")
    rounds = climbed(leaves, scratch)
    subroots = rounds[-1].select("tree", "digest")
    tops = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), scratch, ["of"])
    tops = scratch.keep(tops, "sources")
    top = climbed(tops, scratch)
    none = F.array().cast(PATH)
    root = top[-1].select("tree", "pos", none.alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))

    def source_paths(block: dict[str, list]) -> Iterator[tuple]:
        upper = _pairs(block["path"][0])
        _, steps = traverse(block["digest"], min(HEIGHT, levels(block["n"][0])))
        for of, own, subroot in zip(block["of"], steps, block["digest"], strict=True):
            yield of, 0, _steps(own + upper), subroot, block["root"][0]

    schema = f"tree string, pos long, path {PATH}, subroot string, root string"
    above = grouped(_blocks(top[0], paths(top, root, scratch)), ["tree", "block"], ["pos"], source_paths, schema)
    above = paths(rounds, scratch.keep(above, "tops"), scratch)

    def proofs(block: dict[str, list]) -> Iterator[tuple]:
        upper, subroot, root = _pairs(block["path"][0]), block["subroot"][0], block["root"][0]
        _, steps = traverse(block["digest"], min(HEIGHT, levels(block["n"][0])))
        for doc_id, leaf, other, own in zip(block["doc_id"], block["digest"], block["tampered"], steps, strict=True):
            path = own + upper
            top = folded(other or leaf, path)
            yield doc_id, leaf, subroot, root, digest("".join(others for _, others in path)), top, top == root

    return grouped(_blocks(leaves, above), ["tree", "block"], ["pos"], proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
