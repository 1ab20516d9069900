"""The Merkle manifest against a level-by-level version."""

import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from barweave.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
FIELDS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    steps, members, nodes = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(nodes) > 1:
        for i in range(0, len(nodes), 16):
            for j, own in enumerate(members[i : i + 16]):
                for leaf in own:
                    steps[leaf].append((j, nodes[i : i + 16]))
        members = [sum(members[i : i + 16], []) for i in range(0, len(nodes), 16)]
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], steps


def by_levels(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    each = {s: sorted(v, key=lambda x: x[:3]) for s, v in sources.items()}
    trees = {s: tree([x[2] for x in v]) for s, v in each.items()}
    root, tops = tree([trees[s][0] for s in order])
    out = Counter()
    for s, top in zip(order, tops, strict=True):
        for (_, _, leaf, r), steps in zip(each[s], trees[s][1], strict=True):
            path, node = steps + top, leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = leaf_of((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for j, run in path:
                node = h(*run[:j], node, *run[j + 1 :])
            out[(r[0], leaf, trees[s][0], root, h(*("".join(run[:j] + run[j + 1 :]) for j, run in path)), node, node == root)] += 1
    return out


def test_manifest_of_hard_rows(spark):
    """A source over two blocks, a source of one row, null and repeated rows, clashing names, texts beyond ASCII."""
    rows = [(i, "hot", "en", i, f"Text {i} É") for i in range(4200)] + [(i, None, None, None, None) for i in range(17)]
    rows += [(7, "one", "de", 3, "ÄB"), (None, "é", "fr", 1, "Null"), (None, "é", "fr", 1, "Null"), (5, "z", "en", 2, ""), (5, "z", "en", 2, "A" * 50_000), (5, "z", "en", 2, "")]
    d = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("tree", "pos", "n", "digest", "tie", "block", "path")}).repartition(5)
    got = Counter(tuple(r[c] for c in FIELDS) for r in merkle.merkle_manifest(d).collect())
    assert got == by_levels(rows) and sum(not k[-1] for k in got) > 500


def test_manifest_of_one_and_of_no_row(spark):
    one = [(3, "s", None, 1, "Word")]
    row = merkle.merkle_manifest(spark.createDataFrame(one, SCHEMA)).first()
    assert (row.leaf, row.subroot, row.root, row.proof_sha256) == (leaf_of(one[0]),) * 3 + (h(),)
    assert merkle.merkle_manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_proof_gives_the_root_again():
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 4096):
        leaves = [h(str(i)) for i in range(n)]
        root, steps = merkle.traverse(leaves, merkle.levels(n))
        assert root == tree(leaves)[0]
        assert all(merkle.folded(x, p) == root for x, p in zip(leaves[:: max(1, n // 50)], steps[:: max(1, n // 50)], strict=True))
        assert n == 1 or merkle.folded(h("other"), steps[0]) != root


def test_manifest_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = Counter(tuple(r[c] for c in FIELDS) for r in queries.op12_merkle_manifest(spark, sf).collect())
    assert got == by_levels(rows)
