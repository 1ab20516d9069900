"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages.  Each passage is encoded by its make-up (kinds of characters, word lengths, hashed
byte triples, repetition), a learned layer embeds it, gated attention weighs the passages of a document against each
other, and the weighted embedding is scored.  Only documents have labels; what passages matter is learned from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, utf8
from .labelled import fold, labelled_sample

#: Labelled documents that are learned from at most, words in a passage, buckets of byte triples.
SAMPLE, WORDS, BUCKETS = 6000, 64, 32
#: Passages of a document that are learned from at most, evenly spaced; all of them are scored.
LEARNED = 64
EMBED, ATTEND, EPOCHS, BATCH = 32, 16, 30, 128
#: Passages scored at once.
ROWS = 16

# Kinds of bytes: lower, upper, digit, beyond ASCII, blank, line end, sentence marks, ! and ?, quotes, |, brackets, slashes, @ and _, other symbols
_KIND = np.full(256, 13, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b" \t", b"\n\r\v\f", b".,;:", b"!?", b"\"'`", b"|", b"()[]{}<>", b"/\\", b"@_")):
    _KIND[list(_chars)] = _k
KINDS = 14
FEATURES = KINDS + BUCKETS + 7
_ODD = 0x9E3779B97F4A7C15


def passages(text: bytes | None) -> np.ndarray:
    """One row of FEATURES for each passage of WORDS words; an empty text has one row of zeros."""
    raw = np.frombuffer(text or b"", np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate([[True], space[:-1]])) if len(raw) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros((1, FEATURES), np.float32)
    ends = np.flatnonzero(inside & np.concatenate([space[1:], [True]])) + 1
    n = -(-len(starts) // WORDS)
    cuts = np.concatenate([[0], starts[WORDS::WORDS], [len(raw)]])
    chars = np.diff(cuts).astype(np.float32)
    of_byte = np.repeat(np.arange(n), np.diff(cuts))
    kinds = np.bincount(of_byte * KINDS + _KIND[raw], minlength=n * KINDS).reshape(n, KINDS) / chars[:, None]
    wide = raw.astype(np.int64)
    triple = (wide[:-2] * 961 + wide[1:-1] * 31 + wide[2:]) % 8191 % BUCKETS if len(raw) > 2 else np.zeros(0, np.int64)
    triples = np.bincount(of_byte[: len(triple)] * BUCKETS + triple, minlength=n * BUCKETS).reshape(n, BUCKETS) / chars[:, None]
    size = ends - starts
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(len(raw)))])
    word = (sums[ends] - sums[starts]) * _inverse_powers(len(raw))[starts]  # the same for a word wherever it stands
    of_word = np.arange(len(starts)) // WORDS
    words = np.bincount(of_word, minlength=n).astype(np.float32)
    share = lambda flag: np.bincount(of_word, weights=flag, minlength=n) / words
    same = np.concatenate([[False], word[1:] == word[:-1]])
    run = word.copy()
    for k in range(1, min(4, len(run))):  # runs of four words
        run[:-k] += word[k:] * np.uint64((_ODD * (2 * k + 1)) % (1 << 64))
    seen = np.ones(len(run), bool)
    seen[np.unique(run, return_index=True)[1]] = False
    distinct = np.bincount(_distinct(of_word, word), minlength=n) / words
    mean = share(size) / 10
    spread = np.sqrt(np.clip(share(size.astype(np.float64) ** 2) / 100 - mean**2, 0, None))
    more = np.stack([mean, spread, share(size <= 2), share(same), share(seen), distinct, np.log1p(words) / 5], axis=1)
    return np.concatenate([kinds * 4, triples * 8, more], axis=1).astype(np.float32)


def _distinct(of_word: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The passage of each distinct (passage, word)."""
    order = np.lexsort((word, of_word))
    a, b = of_word[order], word[order]
    return a[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])]


_BASE, _INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_TABLES: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    """base ** k modulo 2 ** 64 for k below n, grown by doubling."""
    t = _TABLES.get(base, np.ones(1, np.uint64))
    while len(t) < n:
        t = np.concatenate([t, t * np.uint64(pow(base, len(t), 1 << 64))])
    _TABLES[base] = t
    return t[:n]


def _powers(n: int) -> np.ndarray:
    return _table(_BASE, n)


def _inverse_powers(n: int) -> np.ndarray:
    return _table(_INVERSE, n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """relu(x W + b) -> gated attention over a bag -> linear score."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        g = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"w": g(FEATURES, EMBED), "b": np.zeros(EMBED, np.float32), "v": g(EMBED, ATTEND), "u": g(EMBED, ATTEND), "a": g(ATTEND, 1)[:, 0], "c": g(EMBED, 1)[:, 0], "d": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)

    def _forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, np.diff(np.append(starts, len(x)))
        x = (x - self.mean) * self.scale
        pre = x @ p["w"] + p["b"]
        h = np.maximum(pre, 0)
        t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * s) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
        att = e / np.repeat(np.add.reduceat(e, starts), n)
        z = np.add.reduceat(h * att[:, None], starts, axis=0)
        return {"x": x, "n": n, "pre": pre, "h": h, "t": t, "s": s, "att": att, "z": z, "y": _sigmoid(z @ p["c"] + p["d"][0])}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        """Each document is scored by itself, in doubles and in blocks of one shape filled up with zeros, so that its
        score doesn't depend on what shares its batch."""
        p = {k: v.astype(np.float64) for k, v in self.p.items()}
        mean, scale = self.mean.astype(np.float64), self.scale.astype(np.float64)
        out = np.zeros(len(bags))
        for i, bag in enumerate(bags):
            each = []
            for at in range(0, len(bag), ROWS):
                own = bag[at : at + ROWS]
                x = np.zeros((ROWS, FEATURES))
                x[: len(own)] = (own - mean) * scale
                h = np.maximum(x @ p["w"] + p["b"], 0)
                e = np.tanh(h @ p["v"]) * _sigmoid(h @ p["u"]) @ p["a"]
                each.append((h[: len(own)], e[: len(own)]))
            h, e = np.concatenate([x for x, _ in each]), np.concatenate([x for _, x in each])
            att = np.exp(e - e.max())
            z = (h * att[:, None]).sum(axis=0) / att.sum()
            out[i] = _sigmoid((z * p["c"]).sum() + p["d"][0])
        return out

    def attention(self, bag: np.ndarray) -> np.ndarray:
        """The weight of each passage of one document."""
        return self._forward(bag, np.zeros(1, np.int64))["att"]

    def _gradients(self, f: dict[str, np.ndarray], y: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, f["n"]
        err = ((f["y"] - y) / len(y)).astype(np.float32)
        dz = np.repeat(err[:, None] * p["c"], n, axis=0)
        dh = dz * f["att"][:, None]
        da = (dz * f["h"]).sum(axis=1)
        de = f["att"] * (da - np.repeat(np.add.reduceat(da * f["att"], starts), n))
        gate = de[:, None] * p["a"]
        dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
        dh = (dh + dt @ p["v"].T + ds @ p["u"].T) * (f["pre"] > 0)
        return {"w": f["x"].T @ dh, "b": dh.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ ds, "a": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ err, "d": err.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 0, l2: float = 1e-4) -> AttentionModel:
        every = np.concatenate(bags)
        self.mean = every.mean(axis=0)
        self.scale = (1 / (every.std(axis=0) + 0.05)).astype(np.float32)
        r, m, v, t = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(EPOCHS):
            order, rate = r.permutation(len(bags)), 3e-3 * (1 - epoch / EPOCHS) + 3e-4
            for i in range(0, len(order), BATCH):
                own = order[i : i + BATCH]
                starts = np.concatenate([[0], np.cumsum([len(bags[k]) for k in own])[:-1]])
                f = self._forward(np.concatenate([bags[k] for k in own]), starts)
                t += 1
                for k, g in self._gradients(f, y[own], starts).items():
                    g = g + l2 * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def quality_model(docs: DataFrame, labels: DataFrame, learn: Column) -> AttentionModel | None:
    """A model of at most SAMPLE labelled documents; none without any.  The driver holds LEARNED passages of FEATURES
    numbers of each at most, 80 MB in all."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [passages(t) for t in utf8(b.column(0))]
            rows = [(x if len(x) <= LEARNED else x[np.linspace(0, len(x) - 1, LEARNED).astype(np.int64)]).tobytes() for x in bags]
            yield pa.record_batch([pa.array(rows, pa.binary()), b.column(1)], ["passages", "y"])

    sample = labelled_sample(docs, labels, "quality", learn, SAMPLE)
    rows = map_arrow(sample.select("text", "y"), encode, "passages binary, y int").orderBy("passages").collect()
    bags = [np.frombuffer(r["passages"], np.float32).reshape(-1, FEATURES) for r in rows]
    y = np.array([r["y"] for r in rows], np.float32)
    return AttentionModel().fit(bags, y) if len(bags) else None


def score_quality(docs: DataFrame, model: AttentionModel | None) -> DataFrame:
    """(doc_id, score) of every whole text; null texts are scored as empty ones; without a model every score is 0.5."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = spread.value
        for b in batches:
            scores = m.scores([passages(t) for t in utf8(b.column(1))]) if m else np.full(len(b), 0.5)
            yield pa.record_batch([b.column(0), pa.array(scores)], ["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), score, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted); rows of fold ``held`` are never learned from.

    Null and empty texts are scored as one passage of zeros.  A null doc_id is never learned from and isn't held out; rows of
    one text score alike, whatever their batch; without labelled rows every score
    is 0.5; an empty table gives no rows; other columns don't matter.
    """
    doc_id = F.col("doc_id")
    scored = score_quality(docs, quality_model(docs, labels, fold(doc_id, folds) != held))
    held_out = F.coalesce(fold(doc_id, folds) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
