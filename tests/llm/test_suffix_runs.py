"""Words said over and over: they are one symbol, so that the sort isn't deepened by them, and their bytes still go."""

import random
from collections import Counter

from barweave.llm import suffix_dedup
from test_suffix_dedup import FIELDS, all_windows


def test_a_word_said_over_is_one_symbol(spark, monkeypatch):
    r = random.Random(3)
    text = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    said = lambda w: f"{w} " * r.randint(55, 160)
    passages = [text(60) for _ in range(6)]
    rows = [(k, f"{text(30)} {said(r.choice(['the', 'of', 'a b']))}{r.choice(passages)} {said('de')}{text(20)}") for k in range(60)]
    rows += [(100, "the " * 51), (101, "x" * 201), (102, "zq" * 100), (103, "zq" * 101 + "!"), (104, "kh " * 400)]
    depth, order = [], suffix_dedup.suffix_order

    def counted(symbols, *rest):
        depth.append(symbols.count())
        return order(symbols, *rest)

    monkeypatch.setattr(suffix_dedup, "suffix_order", counted)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(x[c] for c in FIELDS) for x in suffix_dedup.removed_digest(d).collect())
    assert got == all_windows(rows)
    assert len(depth) <= 2 and depth[0] < 3000
