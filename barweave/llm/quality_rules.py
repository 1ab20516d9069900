"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule rejects a document or lets it pass.  On a sample every rule is timed and what it rejects is counted; rules
then run in the order of rejection per cost, each counted on what the rules before it let pass.  A document stops at
the first rule that rejects it.  The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize
from .pseudonyms import let

#: Documents of the sample on which cost and selectivity are estimated.
SAMPLE = 2000
_SPACE = r"[\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    """Words between ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{_SPACE}+"), lambda w: w != "")


def word_chars(text: Column) -> Column:
    """Characters that aren't white space."""
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.regexp_count(t, F.lit(_SPACE))).cast("long")


def symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[#*$%&|<>]")).cast("long")


def _worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_worded_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words that lie in a run of ``window`` words that occurs twice or more."""

    def count(prints: Column) -> Column:
        def flagged(s: Column) -> Column:
            twin = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
            return F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.get(s, i - 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])

        def covered(s: Column, i: Column) -> Column:
            new = F.least(F.lit(window), i - s["last"])
            return F.struct((s["n"] + new).alias("n"), i.alias("last"))

        placed = F.array_sort(F.transform(prints, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = F.array_sort(let(placed, flagged))
        total = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")), covered)["n"]
        return F.when(F.size(prints) == F.size(F.array_distinct(prints)), F.lit(0)).otherwise(total)

    n = F.size(words)
    prints = F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(n <= window, F.lit(0)).otherwise(let(prints, count)).cast("long")


@dataclass(frozen=True)
class Rule:
    """Rejects a document where ``rejects(text, words)`` is true."""

    name: str
    rejects: Callable[[Column, Column], Column]


def _share(part: Column, whole: Column, percent: int) -> Column:
    return part * 100 > whole * percent


def default_rules() -> list[Rule]:
    n = F.size
    return [
        Rule("too_few_words", lambda t, w: n(w) < 20),
        Rule("repeated_words", lambda t, w: _share(repeated_words(w), n(w), 30)),
        Rule("symbols", lambda t, w: _share(symbols(t), n(w), 30)),
        Rule("exclamations", lambda t, w: _share(F.regexp_count(t, F.lit("[!?]")), n(w), 60)),
        Rule("word_length", lambda t, w: (word_chars(t) < 2 * n(w)) | (word_chars(t) > 25 * n(w))),
        Rule("duplicate_lines", lambda t, w: let(_worded_lines(t), lambda x: _share(n(x) - n(F.array_distinct(x)), n(x), 50))),
        Rule("few_letters", lambda t, w: F.regexp_count(t, F.lit(r"\p{L}")) * 100 < F.length(t) * 40),
        Rule("stutter", lambda t, w: _share(n(F.filter(w, lambda x, i: x == F.get(w, i - 1))), n(w), 25)),
    ]


def base_columns(docs: DataFrame) -> DataFrame:
    """Adds __words (an array), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text, words = F.col("text"), F.col("__words")
    d = docs.withColumn("__words", words_of(text))
    d = d.withColumns({"n_words": F.size(words).cast("long"), "word_chars": word_chars(text), "n_symbols": symbols(text), "n_dup_lines": duplicate_lines(text), "n_repeat_words": repeated_words(words)})
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))


def estimate_order(docs: DataFrame, rules: list[Rule]) -> list[Rule]:
    """The rules by rejection per cost on a sample of about SAMPLE documents, spread over the table by a hash."""
    total = docs.count()
    every = max(1, total // SAMPLE)
    picked = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text", words_of(F.col("text")).alias("w")).limit(2 * SAMPLE)
    sample = materialize(picked, "rule-sample")
    text, words = F.coalesce(F.col("text"), F.lit("")), F.col("w")

    def seconds(*conditions: Column) -> float:
        began = time.perf_counter()
        sample.agg(*[F.count_if(c).alias(f"c{k}") for k, c in enumerate(conditions)], F.sum(F.size(words)), F.sum(F.length(text))).collect()
        return time.perf_counter() - began

    seconds()
    idle = min(seconds(), seconds())
    cost = {r.name: max(seconds(r.rejects(text, words)) - idle, 1e-3) for r in rules}
    flags = [F.coalesce(r.rejects(text, words), F.lit(False)).alias(r.name) for r in rules]
    seen = sample.select(*flags).groupBy(*[r.name for r in rules]).count().collect()  # one row for each combination
    order, left = [], list(rules)
    while left:
        gain = {r.name: sum(x["count"] for x in seen if x[r.name] and not any(x[o.name] for o in order)) for r in left}
        best = max(left, key=lambda r: (gain[r.name] / cost[r.name], -cost[r.name]))
        order.append(best)
        left.remove(best)
    return order


def first_rejection(rules: list[Rule], text: Column, words: Column) -> Column:
    """Name of the first rule that rejects, null if none does; later rules aren't evaluated."""
    chain = None
    for r in rules:
        hit = r.rejects(text, words)
        chain = F.when(hit, F.lit(r.name)) if chain is None else chain.when(hit, F.lit(r.name))
    return chain if chain is not None else F.lit(None).cast("string")


def quality_verdicts(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by).

    A null or empty text has no words and fails the base.  Repeated rows give repeated rows; an empty table gives no
    rows; other columns don't matter.  Which rule rejects a row that several would is a matter of their order, which
    follows measured costs, so ``rejected_by`` may differ between runs; ``kept`` doesn't.
    """
    rules = [r for r in (rules or default_rules()) if r.name not in ("too_few_words", "repeated_words")]
    order = estimate_order(docs, rules)
    d = base_columns(docs.select("doc_id", "text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    by = F.when(F.col("base_failed"), F.lit("base")).otherwise(first_rejection(order, text, F.col("__words")))
    d = d.withColumn("rejected_by", by)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def keep_good(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Documents that no rule rejects, with all their columns; expensive rules see only what the others let pass.

    Null and empty texts have too few words and go; repeated rows and rows without a doc_id are judged each by its text;
    an empty table stays empty; names of other columns don't matter.
    """
    order = estimate_order(docs, rules or default_rules())
    text = F.coalesce(F.col("text"), F.lit(""))
    # words are bound inside the expression: a column would be put in its place again wherever the filter names it
    return docs.where(let(words_of(F.col("text")), lambda w: first_rejection(order, text, w)).isNull())
