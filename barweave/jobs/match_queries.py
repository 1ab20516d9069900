"""Queries of the matching operators: hourly grid, windows of the first 24 (or 6) bars of a trading day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.functions.scratch import settled
from barweave.operators import matching as M
from barweave.registry import query
from barweave.sources.events import BARS, GRID, bars, grid

N = 24
DAY = "CAST(bar_ts - INTERVAL 6 HOUR AS DATE)"


def windows_cte(n: int, source: str = "grid") -> str:
    return f"""pos AS (SELECT *, {DAY} AS day, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS p FROM {source}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY bar_ts) AS k, count(*) OVER (PARTITION BY symbol, day) AS m FROM pos),
raw AS (SELECT symbol, day, min(p) AS start_pos, min(bar_ts) AS start_ts, list(close ORDER BY bar_ts) AS closes, avg(close) AS mu, stddev_pop(close) AS sd FROM ranked WHERE k <= {n} AND m >= {n} GROUP BY 1, 2),
win AS (SELECT symbol, day, start_pos, start_ts, sd, list_transform(closes, lambda x: (x - mu) / sd) AS z FROM raw WHERE sd > 0)"""


def pairs_cte(n: int, past: bool = False) -> str:
    def edge(a: int, b: int) -> str:
        d = lambda s: f"({s}.z[{b + 1}] - {s}.z[{a + 1}])"
        return f"(cos(atan({d('q')}) - atan({d('h')})) + 1) / 2"

    e = M.segment_edges(n)
    segment = " + ".join(edge(a, b) for a, b in zip(e, e[1:], strict=False))
    at = lambda s, f: f"list_position({s}.z, {f}({s}.z))"
    return f"""pairs AS (SELECT q.symbol, q.day AS q_day, h.day AS h_day, h.start_pos, h.start_ts,
  list_dot_product(q.z, h.z) / {n} / (sqrt(list_dot_product(q.z, q.z) / {n} * list_dot_product(h.z, h.z) / {n}) + 1e-10) AS corr,
  ({segment}) / {len(e) - 1} AS segment,
  greatest(0, 1 - 0.6 * (abs({at('q', 'list_max')} - {at('h', 'list_max')}) + abs({at('q', 'list_min')} - {at('h', 'list_min')})) / {n}) AS pivot_sim
  FROM win q JOIN win h ON q.symbol = h.symbol AND h.day {'<' if past else '<>'} q.day),
scored AS (SELECT *, .6 * greatest(corr, 0) + .25 * segment + .15 * pivot_sim AS composite, round(CAST(greatest(0, least(100, 100 * (.6 * greatest(corr, 0) + .25 * segment + .15 * pivot_sim))) AS DECIMAL(18, 9)), 2) AS similarity FROM pairs)"""


WIN = f"{GRID}, {windows_cte(N)}"
PAIRS = f"{WIN}, {pairs_cte(N)}"


def win(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(M.day_windows(grid(spark, sf_dir), N), "windows")


def dated(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in df.columns if c.endswith("trading_date")})


@query(f"WITH {WIN} SELECT symbol, strftime(day, '%Y-%m-%d') AS trading_date, sd, unnest(range({N})) AS i, unnest(z) AS z FROM win", "sd z", "", "i")
def ma1_z_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(win(spark, sf_dir)).select("symbol", "trading_date", "sd", F.posexplode("z").alias("i", "z"))


@query(f"WITH {BARS}, {windows_cte(20, 'bars')} SELECT symbol, strftime(day, '%Y-%m-%d') AS trading_date, start_pos, start_ts, closes[1] AS first_close, closes[20] AS last_close FROM raw WHERE sd > 0", "first_close last_close", "start_ts", "start_pos")
def ma2_day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = dated(M.day_windows(bars(spark, sf_dir), 20))
    return w.select("symbol", "trading_date", "start_pos", "start_ts", F.col("closes")[0].alias("first_close"), F.col("closes")[19].alias("last_close"))


@query(
    f"WITH {WIN}, w AS (SELECT unnest(range({N})) AS i), e AS (SELECT i, exp(-1.5 + 1.5 * i / {N - 1}) AS x FROM w), s AS (SELECT symbol, day, unnest(range({N})) AS i, unnest(z) AS z FROM win) SELECT symbol, strftime(day, '%Y-%m-%d') AS trading_date, sum(z * x) / (SELECT sum(x) FROM e) AS weighted_mean FROM s JOIN e USING (i) GROUP BY 1, 2",
    "weighted_mean",
)
def ma3_decay_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.array(*[F.lit(x) for x in M.decay_weights(N, 1.5)])
    mean = F.aggregate(F.zip_with("z", w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return dated(win(spark, sf_dir)).select("symbol", "trading_date", mean.alias("weighted_mean"))


def pair_query(columns: str, name: str) -> None:
    """Registers one component of the pair scores, computed with array functions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = M.score_pairs(M.candidate_pairs(win(spark, sf_dir)), N).withColumnRenamed("pivot", "pivot_sim")
        return dated(s).select("symbol", F.col("q_trading_date").alias("q_day"), F.col("h_trading_date").alias("h_day"), *columns.split())

    run.__name__ = name
    query(f"WITH {PAIRS} SELECT symbol, strftime(q_day, '%Y-%m-%d') AS q_day, strftime(h_day, '%Y-%m-%d') AS h_day, {', '.join(columns.split())} FROM scored", columns)(run)


pair_query("corr", "ma4_weighted_corr")
pair_query("segment", "ma6_segment_similarity")
pair_query("pivot_sim", "ma7_pivot_timing")


@query(
    f"WITH {WIN} SELECT q.symbol, strftime(q.day, '%Y-%m-%d') AS q_day, strftime(h.day, '%Y-%m-%d') AS h_day, (cos(atan(q.z[{N}] - q.z[1]) - atan(h.z[{N}] - h.z[1])) + 1) / 2 AS slope FROM win q JOIN win h ON q.symbol = h.symbol AND q.day <> h.day",
    "slope",
)
def ma5_slope_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dated(M.candidate_pairs(win(spark, sf_dir)))
    delta = lambda z: F.col(z)[N - 1] - F.col(z)[0]
    return p.select("symbol", F.col("q_trading_date").alias("q_day"), F.col("h_trading_date").alias("h_day"), M.slope_similarity(delta("q_z"), delta("h_z")).alias("slope"))


@query(f"WITH {PAIRS} SELECT symbol, strftime(q_day, '%Y-%m-%d') AS q_day, strftime(h_day, '%Y-%m-%d') AS h_day, composite FROM scored", "composite")
def ma8_composite_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix form."""
    s = dated(M.similar_days(win(spark, sf_dir), N))
    return s.select("symbol", F.col("q_trading_date").alias("q_day"), F.col("h_trading_date").alias("h_day"), "composite")


def dtw_cte(n: int, radius: int, source: str) -> str:
    """DTW of the pairs of ``source`` (id, a, b: lists of n) by recursion over the cells of the band: ``up`` is the row
    above, ``own`` the row so far; cells outside the band are infinite."""
    cost = "(a[i] - b[j]) * (a[i] - b[j])"
    inf = "CAST('inf' AS DOUBLE)"
    pad = f"list_transform(range(1, {n} - j + 1), lambda x: {inf})"
    ahead = f"list_transform(range(0, greatest(1, i + 1 - {radius})), lambda x: {inf})"
    cell = f"{cost} + least(up[j + 1], up[j], own[j])"
    return f"""dtw AS (SELECT id, a, b, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, list_concat([CAST(0 AS DOUBLE)], list_transform(range(0, {n}), lambda x: {inf})) AS up, [{inf}] AS own FROM {source} UNION ALL
  SELECT id, a, b, CASE WHEN last THEN i + 1 ELSE i END, CASE WHEN last THEN greatest(1, i + 1 - {radius}) ELSE j + 1 END, CASE WHEN last THEN list_concat(now, {pad}) ELSE up END, CASE WHEN last THEN {ahead} ELSE now END
  FROM (SELECT *, j >= least({n}, i + {radius}) AS last, list_append(own, {cell}) AS now FROM dtw WHERE i <= {n})),
far AS (SELECT id, sqrt(up[{n + 1}]) / {n} AS dtw FROM dtw WHERE i = {n + 1})"""


DTW_PAIRS = f"""past AS (SELECT row_number() OVER () AS id, q.symbol, q.day AS q_day, h.day AS h_day, q.z AS a, h.z AS b FROM win q JOIN win h ON q.symbol = h.symbol AND h.day < q.day),
{dtw_cte(N, 3, "past")}"""


@query(f"WITH RECURSIVE {WIN}, {DTW_PAIRS} SELECT symbol, strftime(q_day, '%Y-%m-%d') AS q_trading_date, strftime(h_day, '%Y-%m-%d') AS h_trading_date, dtw FROM past JOIN far USING (id)", "dtw")
def ma9_banded_dtw(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = M.candidate_pairs(win(spark, sf_dir), past_only=True)
    return dated(p.withColumn("dtw", M.dtw_distance(F.col("q_z"), F.col("h_z"), 3))).select("symbol", "q_trading_date", "h_trading_date", "dtw")


WITH_DTW = f"""{WIN}, {pairs_cte(N).replace("pairs AS (SELECT", "pairs AS (SELECT row_number() OVER () AS id, q.z AS a, h.z AS b,")}"""
BONUS = """bonus AS (SELECT scored.* EXCLUDE (similarity), dtw, greatest(-5, least(5, (.20 - dtw) * 25)) AS bonus FROM scored JOIN far USING (id)),
rated AS (SELECT *, CAST(round(CAST(greatest(0, least(100, 100 * composite + bonus)) AS DECIMAL(18, 9)), 2) AS DOUBLE) AS similarity FROM bonus)"""


@query(f"WITH RECURSIVE {WITH_DTW}, {dtw_cte(N, 3, '(SELECT * FROM pairs WHERE h_day < q_day)')}, {BONUS} SELECT symbol, strftime(q_day, '%Y-%m-%d') AS q_trading_date, strftime(h_day, '%Y-%m-%d') AS h_trading_date, similarity FROM rated", "similarity")
def ma10_similarity_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.score_pairs(M.candidate_pairs(win(spark, sf_dir), past_only=True), N)
    pct = M.similarity_pct(F.col("composite"), M.dtw_distance(F.col("q_z"), F.col("h_z"), 3))
    return dated(s.withColumn("similarity", pct)).select("symbol", "q_trading_date", "h_trading_date", "similarity")


LADDER = """best AS (SELECT symbol, q_day, max(similarity) AS best FROM scored GROUP BY 1, 2),
rung AS (SELECT *, CASE WHEN best >= 70 THEN 0 WHEN best >= 65 THEN 1 WHEN best >= 60 THEN 2 WHEN best >= 55 THEN 3 END AS attempt FROM best)"""


@query(f"WITH {PAIRS}, {LADDER} SELECT symbol, strftime(q_day, '%Y-%m-%d') AS q_day, coalesce(attempt, -1) AS attempt, count(*) FILTER (similarity >= 70 - 5 * attempt) AS n_pass FROM scored JOIN rung USING (symbol, q_day) GROUP BY 1, 2, 3", "", "", "attempt n_pass")
def ma11_threshold_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.similar_days(win(spark, sf_dir), N).withColumn("similarity", M.similarity_pct(F.col("composite")))
    d = dated(M.threshold_ladder(s))
    return d.groupBy("symbol", F.col("q_trading_date").alias("q_day"), F.coalesce("attempt", F.lit(-1)).alias("attempt")).agg(F.count_if("passes").alias("n_pass"))


def nms_cte(radius: int) -> str:
    """Three rounds of taking the best candidate that lies outside the radius of those taken before."""
    first = "pass AS (SELECT s.* FROM scored s JOIN rung r USING (symbol, q_day) WHERE similarity >= 70 - 5 * attempt)"
    rounds = []
    for k in (1, 2, 3):
        taken = "".join(f" AND NOT EXISTS (SELECT 1 FROM t{j} t WHERE t.symbol = p.symbol AND t.q_day = p.q_day AND abs(t.start_pos - p.start_pos) <= {radius})" for j in range(1, k))
        rounds.append(f"t{k} AS (SELECT *, {k} AS rank FROM pass p WHERE TRUE{taken} QUALIFY row_number() OVER (PARTITION BY symbol, q_day ORDER BY composite DESC, start_ts) = 1)")
    return f"{LADDER}, {first}, {', '.join(rounds)}, chosen AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)"


@query(f"WITH {PAIRS}, {nms_cte(30)} SELECT symbol, strftime(q_day, '%Y-%m-%d') AS q_day, rank, strftime(h_day, '%Y-%m-%d') AS h_day, start_pos, composite FROM chosen", "composite", "", "rank start_pos")
def ma12_top_k_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.similar_days(win(spark, sf_dir), N).withColumn("similarity", M.similarity_pct(F.col("composite")))
    top = dated(M.top_k_nms(M.threshold_ladder(s), 3, 30, N))
    return top.select("symbol", F.col("q_trading_date").alias("q_day"), "rank", F.col("h_trading_date").alias("h_day"), F.col("h_start_pos").alias("start_pos"), "composite")


@query(
    f"""WITH {PAIRS}, c AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (100 * composite >= 55) OVER w AS m FROM scored WINDOW w AS (PARTITION BY symbol, q_day))
    SELECT symbol, strftime(q_day, '%Y-%m-%d') AS q_day, count(*) AS n_kept FROM c WHERE NOT (n > 12 AND m >= 6) OR 100 * composite >= 55 GROUP BY 1, 2""",
    "",
    "",
    "n_kept",
)
def ma13_prune_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dated(M.prune_candidates(M.similar_days(win(spark, sf_dir), N)))
    return d.groupBy("symbol", F.col("q_trading_date").alias("q_day")).agg(F.count("*").alias("n_kept"))


@query(f"WITH {PAIRS}, {nms_cte(23)} SELECT symbol, strftime(q_day, '%Y-%m-%d') AS q_day, rank, strftime(h_day, '%Y-%m-%d') AS h_day, similarity, corr FROM chosen", "similarity corr", "", "rank")
def ma14_match_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = dated(M.match_days(grid(spark, sf_dir), N, radius=23, dtw_radius=None))
    return top.select("symbol", F.col("q_trading_date").alias("q_day"), "rank", F.col("h_trading_date").alias("h_day"), "similarity", "corr")


@query(
    f"""WITH RECURSIVE {WITH_DTW}, {dtw_cte(N, 3, "pairs")}, {BONUS}, {nms_cte(23).replace("FROM scored", "FROM rated")} SELECT symbol, strftime(q_day, '%Y-%m-%d') AS q_day, c.rank, strftime(h_day, '%Y-%m-%d') AS h_day, similarity,
    CAST(round(CAST(bonus AS DECIMAL(18, 9)), 2) AS DOUBLE) AS dtw_bonus, r.attempt > 0 AS low_confidence FROM chosen c JOIN rung r USING (symbol, q_day)""",
    "similarity dtw_bonus",
    "",
    "rank",
)
def ma14_match_days_dtw(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = dated(M.match_days(grid(spark, sf_dir), N, radius=23, dtw_radius=3))
    return top.select("symbol", F.col("q_trading_date").alias("q_day"), "rank", F.col("h_trading_date").alias("h_day"), "similarity", "dtw_bonus", "low_confidence")
