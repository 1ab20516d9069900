"""Repeated byte strings against all windows of all texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.llm import queries, suffix_dedup
from barweave.llm._common import Scratch

FIELDS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def all_windows(rows, length=200):
    raw = [(t or "").encode() for _, t in rows]
    places = defaultdict(list)
    for k, t in enumerate(raw):
        for p in range(len(t) - length + 1):
            places[t[p : p + length]].append((k, p))
    gone = [np.zeros(len(t), bool) for t in raw]
    for found in places.values():
        if len(found) > 1:
            for k, p in found:
                gone[k][p : p + length] = True
    out = Counter()
    for (doc_id, _), t, g in zip(rows, raw, gone, strict=True):
        kept = np.frombuffer(t, np.uint8)[~g].tobytes()
        spans = int((np.diff(np.concatenate([[0], g.astype(np.int8)])) == 1).sum())
        out[(doc_id, len(t), int(g.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def hard_texts(seed):
    r = random.Random(seed)
    words = [f"w{i}é" for i in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [text(n) for n in (10, 20, 28, 29, 30, 31, 32, 35, 40, 60, 200)]
    out = [text(r.randint(1, 150)) for _ in range(30)]
    for _ in range(60):  # passages in other surroundings, cut at any byte
        p = r.choice(passages)
        i, j = r.randint(0, len(p) // 3), r.randint(len(p) // 2, len(p))
        out.append(text(r.randint(0, 30)) + p[i:j] + text(r.randint(0, 30)) + (r.choice(passages) if r.random() < 0.3 else ""))
    for _ in range(15):  # near copies
        w = out[0].split() + out[1].split() + out[2].split()
        w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    p = passages[-1]
    out += [p + " x " + p, "a" * 700, "b" * 199, "b" * 200, "b" * 201, "ab" * 300, "abc" * 150 + "z" + "abc" * 90, out[5], out[5], out[5], "short", "short", "", None, None]
    out += ["x" + p[:200], "y" + p[1:201], p[100:299] + "?", p[100:300] + "?"]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_bytes_are_removed(spark, seed):
    rows = [*enumerate(hard_texts(seed)), (None, "no id " * 60), (3, "again " * 60), (3, "again " * 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "tid", "seq", "i", "a", "lo", "c", "start", "body", "t1", "n_bytes")}).repartition(3)
    got = Counter(tuple(x[c] for c in FIELDS) for x in suffix_dedup.removed_digest(d).collect())
    assert got == all_windows(rows)


def test_nothing_repeats_and_no_rows(spark):
    rows = [(1, " ".join(map(str, range(500)))), (2, None), (3, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(x[c] for c in FIELDS) for x in suffix_dedup.removed_digest(d).collect()) == all_windows(rows)
    assert suffix_dedup.removed_digest(d.limit(0)).count() == 0


def test_suffixes_are_sorted(spark):
    """Strings over two letters with long repeats: the algorithm recurses, and the order is that of the suffixes."""
    r = random.Random(7)
    strings = [[r.randint(1, 2) for _ in range(r.randint(1, 60))] for _ in range(12)] + [[1, 2] * 40, [1, 2] * 40, [2] * 50, [1]]
    rows = [(k, i, s, 1) for k, x in enumerate(strings) for i, s in enumerate(x)]
    d = spark.createDataFrame(rows, "seq long, i long, sym long, size long")
    found = sorted(suffix_dedup.suffix_order(d, 10**9, Scratch(spark)).collect(), key=lambda x: x["at"])
    suffixes = [tuple(strings[x.seq][x.i :]) for x in found]
    assert len(found) == len(rows) and suffixes == sorted(suffixes)


def test_anchors_depend_on_their_window_alone(monkeypatch):
    r = np.random.default_rng(1)
    for data in (r.integers(97, 100, 3000).astype(np.uint8), np.full(900, 97, np.uint8), r.integers(0, 256, 199).astype(np.uint8)):
        whole = suffix_dedup.anchors(data, 200)
        assert len(whole) == max(0, len(data) - 199)
        assert all(suffix_dedup.anchors(data[p : p + 200], 200)[0] == whole[p] - p for p in range(0, len(whole), 7))
        monkeypatch.setattr(suffix_dedup, "SEGMENT", 257)
        assert suffix_dedup.anchors(data, 200).tolist() == whole.tolist()
        monkeypatch.undo()


def test_dedup_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(x[c] for c in FIELDS) for x in queries.op11_suffix_dedup(spark, sf).collect())
    assert got == all_windows(rows) and sum(k[2] > 0 for k in got) > 10
