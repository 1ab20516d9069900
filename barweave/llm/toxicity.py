"""Toxicity by weak supervision.

Voters are terms: words of a lexicon, and words and word beginnings that labelled rows show to be unusual in toxic
texts.  A generative model with a hidden class says how often each voter fires in either class; expectation
maximization over the vote patterns of all documents estimates that, and a second pass the correlations between voters,
by which correlated votes are discounted.  The posteriors of a bounded sample of labelled rows, with LABEL_WEIGHT
log-odds of the label added, train a linear classifier over many more terms, which scores every whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import alnum_words, map_arrow, materialize, utf8
from .labelled import fold, labelled_sample

#: Labelled rows that are learned from at most; voters; terms of the linear classifier.
SAMPLE, VOTERS, TERMS = 20_000, 64, 1000
#: Bytes of word beginnings that count as terms.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Voters that need no labels.
LEXICON = "idiot moron stupid dumb pathetic worthless disgusting scum trash loser clown fool creep filth vermin imbecile".split()
EM_ROUNDS = 8
#: Log-odds that a label of a labelled row adds to its posterior.
LABEL_WEIGHT = 4.0


def term_names(word: bytes) -> list[bytes]:
    return [word, *[word[:k] + b"*" for k in BEGINNINGS if len(word) > k]]


@dataclass
class TermFinder:
    """Which of the known terms a text has; a memo holds the terms of each word."""

    index: dict[bytes, int]
    memo: dict[bytes, tuple[int, ...]] = field(default_factory=dict)

    def of(self, text: bytes | None) -> list[int]:
        found: set[int] = set()
        if len(self.memo) > 400_000:
            self.memo.clear()
        memo = self.memo
        for w in set(alnum_words(text)):
            ids = memo.get(w)
            if ids is None:
                ids = memo[w] = tuple(self.index[t] for t in term_names(w) if t in self.index)
            if ids:
                found.update(ids)
        return sorted(found)


def _term_counts(sample: DataFrame) -> DataFrame:
    """(term, n1, n0): toxic and other documents of the sample that have each term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(utf8(b.column(0)), b.column(1).to_pylist(), strict=True):
                seen[y].update({t for w in set(alnum_words(text)) for t in term_names(w)})
            terms = list(seen[0].keys() | seen[1].keys())
            yield pa.record_batch([pa.array(terms, pa.binary()), pa.array([seen[1][t] for t in terms]), pa.array([seen[0][t] for t in terms])], ["term", "n1", "n0"])

    return map_arrow(sample.select("text", "y"), count, "term binary, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def find_terms(sample: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """The voters and the classifier's terms; both lists are bounded."""
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    lexicon = [w.encode() for w in LEXICON]
    if not n1 or not n0:
        return lexicon, lexicon
    counts = _term_counts(sample).where(F.col("n1") + F.col("n0") >= 5)
    p1, p0 = (F.col("n1") + 0.5) / (n1 + 1.0), (F.col("n0") + 0.5) / (n0 + 1.0)
    gain = F.abs(p1 - p0) * F.abs(F.log(p1 / p0))
    counts = counts.select("term", "n1", "n0", gain.alias("gain"), F.log(p1 / p0).alias("lift"))
    best = counts.orderBy(F.desc("gain"), "term").limit(TERMS).collect()
    voters = [bytes(r["term"]) for r in best if r["lift"] > 2.0][: VOTERS - len(lexicon)]
    return list(dict.fromkeys(lexicon + voters)), list(dict.fromkeys(lexicon + [bytes(r["term"]) for r in best]))


def vote_patterns(docs: DataFrame, voters: list[bytes]) -> DataFrame:
    """(pattern, n): how many of all documents fire each combination of voters; bit k of pattern is voter k."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, seen = TermFinder({t: k for k, t in enumerate(voters)}), Counter()
        for b in batches:
            seen.update(_bits(finder.of(t)) for t in utf8(b.column(0)))
        yield pa.record_batch([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    return map_arrow(docs.select("text"), vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def _bits(ids: list[int]) -> int:
    x = sum(1 << k for k in ids)
    return x - (1 << 64) if x >> 63 else x


def _votes(patterns: np.ndarray, m: int) -> np.ndarray:
    return ((patterns.astype(np.int64).view(np.uint64)[:, None] >> np.arange(m, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)


@dataclass
class LabelModel:
    """prior: share of toxic documents; rates: how often each voter fires in class 0 and 1; discount: by correlation."""

    prior: float
    rates: np.ndarray
    discount: np.ndarray

    def logit(self, votes: np.ndarray) -> np.ndarray:
        r = self.rates
        fires, silent = np.log(r[1] / r[0]), np.log((1 - r[1]) / (1 - r[0]))
        return np.log(self.prior / (1 - self.prior)) + votes @ ((fires - silent) * self.discount) + (silent * self.discount).sum()

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(votes), -30, 30)))


def _moments(patterns: DataFrame, model: LabelModel, second: bool) -> np.ndarray:
    """Sums over all documents, by class: weight, fires of each voter, and with ``second`` of each pair of voters."""
    m = len(model.discount)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + m + (m * m if second else 0)))
        for b in batches:
            x, n = _votes(b.column(0).to_numpy(), m), b.column(1).to_numpy()
            p = model.posterior(x)
            for c, w in ((0, n * (1 - p)), (1, n * p)):
                total[c, 0] += w.sum()
                total[c, 1 : 1 + m] += w @ x
                if second:
                    total[c, 1 + m :] += ((x * w[:, None]).T @ x).ravel()
        flat = total.ravel()
        some = np.flatnonzero(flat)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(flat[some])], ["k", "v"])

    rows = map_arrow(patterns, add, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(2 * (1 + m + (m * m if second else 0)))
    for r in rows:
        out[r["k"]] = r["v"]
    return out.reshape(2, -1)


def fit_label_model(patterns: DataFrame, m: int, start: np.ndarray | None = None) -> LabelModel:
    """Expectation maximization over the vote patterns of all documents; every round sends 2 * (m + 1) numbers."""
    rates = np.stack([np.full(m, 0.01), np.full(m, 0.2)]) if start is None else np.clip(start, 1e-4, 0.95)
    model = LabelModel(0.1, rates, np.ones(m))
    for _ in range(EM_ROUNDS):
        s = _moments(patterns, model, False)
        if s[:, 0].sum() == 0:
            break
        prior = np.clip(s[1, 0] / s[:, 0].sum(), 1e-4, 0.5)
        # counts of one document in a thousand on either side keep rates off 0, and a voter never turns its back on its class
        rates = (s[:, 1:] + 1e-3 * s[:, :1].clip(1)) / (s[:, :1].clip(1) * 1.002)
        rates[1] = np.maximum(rates[1], 1.5 * rates[0])
        model = LabelModel(float(prior), np.clip(rates, 1e-4, 0.95), np.ones(m))
    s = _moments(patterns, model, True)
    worst = np.zeros((m, m))
    for c in (0, 1):
        n = max(s[c, 0], 1.0)
        mean, pair = s[c, 1 : 1 + m] / n, s[c, 1 + m :].reshape(m, m) / n
        cov = pair - np.outer(mean, mean)
        sd = np.sqrt(np.clip(mean * (1 - mean), 1e-9, None))
        worst = np.maximum(worst, np.clip(cov / np.outer(sd, sd), 0, 1))
    np.fill_diagonal(worst, 0)
    worst[worst < 0.3] = 0
    model.discount = 1 / (1 + worst.sum(axis=1))
    return model


def fit_linear(terms: list[list[int]], target: np.ndarray, size: int, l2: float = 0.1, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression of term presence on soft labels, by full-batch Adam."""
    x = np.zeros((len(terms), size), np.float32)
    for i, ids in enumerate(terms):
        x[i, ids] = 1
    w, b, n = np.zeros(size, np.float32), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))), max(len(terms), 1)
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        err = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - target).astype(np.float32)
        g = np.append(x.T @ err / n + l2 * w / n, err.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - float(step[-1])
    return w, b


def toxicity_model(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[list[bytes], np.ndarray, float]:
    """Terms, weights and bias of the classifier.  Without labelled rows the lexicon's posterior stands alone."""
    sample = materialize(labelled_sample(docs, labels, "toxic", learn, SAMPLE), "labelled")
    voters, terms = find_terms(sample)
    m = len(voters)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote, term = TermFinder({t: k for k, t in enumerate(voters)}), TermFinder({t: k for k, t in enumerate(terms)})
        for b in batches:
            texts = utf8(b.column(0))
            yield pa.record_batch([pa.array([_bits(vote.of(t)) for t in texts], pa.int64()), pa.array([term.of(t) for t in texts], pa.list_(pa.int32())), b.column(1)], ["pattern", "terms", "y"])

    rows = map_arrow(sample.select("text", "y"), find, "pattern long, terms array<int>, y int").toPandas()  # at most SAMPLE rows of term numbers
    votes = _votes(rows["pattern"].to_numpy(), m) if len(rows) else np.zeros((0, m))
    y = rows["y"].to_numpy(np.float64)
    start = None
    if 0 < y.sum() < len(y):
        start = np.stack([(votes[y == c].sum(axis=0) + 0.05) / ((y == c).sum() + 1) for c in (0, 1)])
    model = fit_label_model(materialize(vote_patterns(docs, voters), "votes"), m, start)
    if not len(rows):
        r = model.rates
        return voters, (np.log(r[1] / r[0]) * model.discount).astype(np.float32), -3.0
    logit = model.logit(votes) + LABEL_WEIGHT * (2 * y - 1)
    target = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    weights, bias = fit_linear(rows["terms"].tolist(), target, len(terms))
    return terms, weights, bias


def score_toxicity(docs: DataFrame, terms: list[bytes], weights: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, score) of every whole text; null and empty texts have no terms."""
    spread = docs.sparkSession.sparkContext.broadcast((terms, weights))  # TERMS entries

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, w = spread.value
        finder = TermFinder({t: k for k, t in enumerate(names)})
        for b in batches:
            logit = np.array([bias + float(w[ids].sum()) if (ids := finder.of(t)) else bias for t in utf8(b.column(1))])
            yield pa.record_batch([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))], ["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), score, "doc_id long, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted); rows of fold ``held`` are never learned from.

    Null texts score like empty ones; a null doc_id is never learned from and isn't held out; repeated rows score alike.
    Without labelled rows the lexicon's voters score alone; an empty table gives no rows; other columns don't matter.
    """
    doc_id = F.col("doc_id")
    scored = score_toxicity(docs, *toxicity_model(docs, labels, fold(doc_id, folds) != held))
    held_out = F.coalesce(fold(doc_id, folds) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
