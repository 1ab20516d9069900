"""The registered queries of this package over the tables of a data folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontamination, merkle, ngram_join, packing, pseudonyms, quality_model, quality_rules, sharding, suffix_dedup, token_counts, token_files, toxicity
from ._common import table
from .encoding import vocabulary_path


#: Who uses the pseudonyms keeps a secret of their own.
PSEUDONYM_KEY = "set-your-own-key"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = token_counts.length_histogram(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    return token_counts.length_totals(histogram)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the rejecting rule depends on the order found on the sample
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents")).drop("rejected_by")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_digest(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.token_alignment(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_pseudonyms,
        op3_benchmark_decontamination,
        op4_token_files,
        op5_packing,
        op6_quality_model,
        op7_token_counts,
        op8_ngram_jaccard_join,
        op9_quality_rules,
        op10_sharding,
        op11_suffix_dedup,
        op12_merkle_manifest,
        op13_token_alignment,
    )
}

_OP3 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bw),
sizes AS (SELECT DISTINCT n FROM windows),
dw AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT DISTINCT r, i, dw.n, item_id FROM dw JOIN windows ON windows.n = dw.n AND windows.s = array_to_string(dw.w[i:i + dw.n - 1], ' ')),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
owners AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN owners USING (r)
"""

_OP9 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
rep AS (SELECT r, sum(least(8, i - p)) AS n FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), i - 8) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(DISTINCT x) AS u FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
twins AS (SELECT r, count(*) AS n FROM (SELECT r, unnest(range(2, len(w) + 1)) AS i, w FROM d) WHERE w[i] = w[i - 1] GROUP BY r),
m AS (
  SELECT d.r, doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(t) - len(regexp_extract_all(t, '[\\x20\\x09-\\x0D]')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n - lines.u, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines, coalesce(twins.n, 0) AS n_twins,
    len(regexp_extract_all(t, '[!?]')) AS n_cries, len(regexp_extract_all(t, '\\pL')) AS n_letters
  FROM d LEFT JOIN rep USING (r) LEFT JOIN lines USING (r) LEFT JOIN twins USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_cries > 60 * n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words
    OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_letters < 40 * length(t) OR 100 * n_twins > 25 * n_words) AS kept
FROM b
"""



def _tree_sql(name: str, leaves: str, levels: int) -> str:
    """Nodes {name}0, {name}1, ... (t, i, n, d) over the rows (t, i, n, d) of ``leaves``, and {name}p0, ... with the siblings
    before and after each node of a level that has several."""
    out = [f"{name}0 AS (SELECT t, i, n, d FROM {leaves})"]
    for k in range(levels):
        out.append(f"{name}{k + 1} AS (SELECT t, i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d FROM {name}{k} GROUP BY t, i // 16, n)")
        pair = f"{name}{k} a JOIN {name}{k} b ON a.t = b.t AND a.i // 16 = b.i // 16"
        side = lambda op: f"coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i {op} a.i), '')"
        out.append(f"{name}p{k} AS (SELECT a.t, a.i, {side('<')} AS ahead, {side('>')} AS behind FROM {pair} WHERE a.n > 1 GROUP BY a.t, a.i)")
    return ", ".join(out)


def _fold_sql(name: str, before: str, levels: int, tree: str, at: str) -> str:
    """Rows of ``before`` with x folded up the levels of a tree, and what the siblings say added to ``said``."""
    out = []
    for k in range(levels):
        row = f"SELECT r.* EXCLUDE (x, said), said || coalesce(ahead || behind, '') AS said, CASE WHEN p.t IS NULL THEN x ELSE sha256(ahead || x || behind) END AS x"
        out.append(f"{name}f{k} AS ({row} FROM {before if k == 0 else f'{name}f{k - 1}'} r LEFT JOIN {name}p{k} p ON p.t = {tree} AND p.i = {at} // {16**k})")
    return ", ".join(out)


#: Levels of a source's tree and of the sources' tree that the SQL is written out for: 16 ** 5 rows, 16 ** 3 sources.
_DEEP, _WIDE = 5, 3
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_LOW = _LEAF.replace("CAST(text AS VARCHAR)", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
_CRC = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_concat([xor(a, b)], CAST(range(8) AS BIGINT[])), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
_OP12 = f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS t, sha256({_LEAF}) AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN sha256({_LOW}) END AS low FROM documents),
l AS (SELECT *, leaf AS d, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM d),
{_tree_sql("a", "l", _DEEP)},
s AS (SELECT '' AS t, t AS of, d, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM a{_DEEP}),
{_tree_sql("b", "s", _WIDE)},
r0 AS (SELECT l.doc_id, l.t, l.i, l.leaf, s.d AS subroot, s.i AS si, '' AS said, coalesce(low, leaf) AS x FROM l JOIN s ON s.of = l.t),
{_fold_sql("a", "r0", _DEEP, "r.t", "r.i")},
{_fold_sql("b", f"af{_DEEP - 1}", _WIDE, "''", "r.si")}
SELECT doc_id, leaf, subroot, b{_WIDE}.d AS root, sha256(said) AS proof_sha256, x AS folded_root, x = b{_WIDE}.d AS verified FROM bf{_WIDE - 1}, b{_WIDE}
"""

ORACLE_SQL: dict[str, str] = {"op3_benchmark_decontamination": _OP3, "op9_quality_rules": _OP9, "op12_merkle_manifest": _OP12}
