"""Queries of the forecast operators: top-3 matches of 24-bar days of the hourly grid, six steps ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.functions.scratch import settled
from barweave.jobs.feature_queries import BIAS, DAILY, daily_closes
from barweave.jobs.learn_queries import feedback
from barweave.jobs.match_queries import N, PAIRS, WIN, dated, nms_cte, pairs_cte
from barweave.operators import backtest as B
from barweave.operators import features as X
from barweave.operators import forecast as P
from barweave.operators import matching as M
from barweave.registry import query
from barweave.sources.events import BARS, bars, grid

STEPS = 6
BASE = f"{PAIRS}, {nms_cte(23)}"
WT = """wt AS (SELECT *, exp((similarity - max(similarity) OVER q) / tau) / sum(exp((similarity - mx) / tau)) OVER q AS weight FROM (
  SELECT *, max(similarity) OVER q AS mx, CASE WHEN count(*) OVER q > 1 THEN greatest(2.5, least(6, stddev_pop(similarity) OVER q * 1.5 + 2.5)) ELSE 3.5 END AS tau FROM chosen WINDOW q AS (PARTITION BY symbol, q_day)) WINDOW q AS (PARTITION BY symbol, q_day))"""
ST = f"""st AS (SELECT symbol, p, close, CASE WHEN p >= 4 THEN avg(abs(diff)) OVER f29 ELSE .2 END AS abs_move, CASE WHEN p >= 29 THEN stddev_pop(close) OVER f30 END AS vol30 FROM
  (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY p) AS diff FROM pos) WINDOW f29 AS (PARTITION BY symbol ORDER BY p ROWS BETWEEN 28 PRECEDING AND CURRENT ROW), f30 AS (PARTITION BY symbol ORDER BY p ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
qs AS (SELECT w.symbol, w.day AS q_day, w.start_pos AS q_pos, s.close AS last_price, s.abs_move, s.vol30 FROM win w JOIN st s ON s.symbol = w.symbol AND s.p = w.start_pos + {N - 1})"""
FUT = f"""fut AS (SELECT c.symbol, c.q_day, c.rank, s.step, p.close FROM (SELECT *, (SELECT max(p) FROM pos WHERE pos.symbol = chosen.symbol) AS last_p FROM chosen) c, (SELECT unnest(range(0, {STEPS + 1})) AS step) s
  JOIN pos p ON p.symbol = c.symbol AND p.p = least(c.start_pos + {N - 1} + s.step, c.last_p))"""
RATIO = f"""hm AS (SELECT c.symbol, c.q_day, c.rank, avg(abs(p.close - b.close)) AS h FROM chosen c JOIN pos p ON p.symbol = c.symbol AND p.p BETWEEN c.start_pos + 1 AND c.start_pos + {N - 1} JOIN pos b ON b.symbol = p.symbol AND b.p = p.p - 1 GROUP BY 1, 2, 3),
ratio AS (SELECT hm.*, last_price, CASE WHEN h > 1e-4 THEN greatest(.75, least(1.25, abs_move / h)) ELSE 1.0 END AS ratio FROM hm JOIN qs USING (symbol, q_day))"""
PATH = f"""{FUT}, {RATIO}, mv AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol, q_day, rank ORDER BY step) AS d FROM fut),
path AS (SELECT symbol, q_day, rank, step, last_price, last_price + sum(greatest(-.35, least(.35, d * ratio))) OVER (PARTITION BY symbol, q_day, rank ORDER BY step) AS price FROM mv JOIN ratio USING (symbol, q_day, rank) WHERE step > 0),
pr AS (SELECT *, price / (last_price + 1e-8) AS r FROM path)"""
ALL = f"{BASE}, {WT}, {ST}, {PATH}"
QD = "symbol, strftime(q_day, '%Y-%m-%d') AS q_day"


def top(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Grid bars, windows and matches, each written once."""
    g = settled(grid(spark, sf_dir), "grid")
    g = settled(P.placed(g), "placed")
    return g, settled(M.day_windows(g, N), "windows"), settled(M.match_days(g, N, radius=23, dtw_radius=None), "matches")


def paths_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    g, w, m = top(spark, sf_dir)
    q = settled(P.query_prices(g, w, N), "queries")
    paths = P.project_path(P.vol_ratio(P.match_future(P.softmax_weights(m), g, N, STEPS), g, q, N), STEPS)
    return g, q, m, settled(paths, "paths")


def named(df: DataFrame, *cols) -> DataFrame:
    return dated(df).select("symbol", F.col("q_trading_date").alias("q_day"), *cols)


@query(f"WITH {BASE}, {WT} SELECT {QD}, rank, tau, weight FROM wt", "tau weight", "", "rank")
def fc1_softmax_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(P.softmax_weights(top(spark, sf_dir)[2]), "rank", "tau", "weight")


@query(f"WITH {BASE}, {FUT} SELECT {QD}, rank, step, close FROM fut", "close", "", "rank step")
def fc2_match_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _, m = top(spark, sf_dir)
    f = P.match_future(m, g, N, STEPS)
    return named(f, "rank", F.posexplode(F.concat(F.array("anchor"), "future")).alias("step", "close"))


@query(f"WITH {BASE}, {ST}, {RATIO} SELECT {QD}, rank, ratio FROM ratio", "ratio", "", "rank")
def fc3_vol_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, w, m = top(spark, sf_dir)
    return named(P.vol_ratio(m, g, P.query_prices(g, w, N), N), "rank", "ratio")


@query(f"WITH {ALL} SELECT {QD}, rank, step - 1 AS step, price FROM path", "price", "", "rank step")
def fc4_project_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(paths_of(spark, sf_dir)[3], "rank", F.posexplode("path").alias("step", "price"))


@query(
    f"""WITH {ALL} SELECT {QD}, rank, similarity, CAST(round(CAST(c.corr AS DECIMAL(18, 12)), 4) AS DOUBLE) AS corr, start_ts AS start_time,
    CAST(round(CAST(p.price AS DECIMAL(18, 9)), 2) AS DOUBLE) AS last_point FROM chosen c JOIN path p USING (symbol, q_day, rank) WHERE step = {STEPS}""",
    "similarity corr last_point",
    "start_time",
    "rank",
)
def fc5_history_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = named(P.history_tracks(paths_of(spark, sf_dir)[3]), F.explode("tracks").alias("t"))
    return t.select("symbol", "q_day", "t.rank", "t.similarity", "t.corr", "t.start_time", F.element_at("t.path", -1).alias("last_point"))


@query(
    f"""WITH {BASE}, sp AS (SELECT c.symbol, c.q_day, p.p - c.start_pos AS step, p.close FROM chosen c JOIN pos p ON p.symbol = c.symbol AND p.p BETWEEN c.start_pos AND c.start_pos + {N - 1 + STEPS} WHERE rank = 1),
    h AS (SELECT symbol, q_day, avg(close) AS h FROM sp WHERE step < {N} GROUP BY 1, 2), t AS (SELECT symbol, day AS q_day, list_avg(closes) AS t FROM raw)
    SELECT {QD}, step, CAST(round(CAST(close - h + t AS DECIMAL(18, 9)), 2) AS DOUBLE) AS price FROM sp JOIN h USING (symbol, q_day) JOIN t USING (symbol, q_day)""",
    "price",
    "",
    "step",
)
def fc6_mean_aligned_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, w, m = top(spark, sf_dir)
    return named(P.mean_aligned_track(m, g, P.query_prices(g, w, N), N, STEPS), "step", "price")


MATCHED = {i: name for i, (name, _, _) in enumerate(X.FEATURES) if name in ("inst", "hist_sim", "hist_consensus", "hist_return", "dxy", "us10y", "macro")}
_SCALED = ", ".join(f"({i}, greatest(-3, least(3, ({v} - {m}) / ({s} + 1e-8))))" for i, v, m, s in ((i, {"inst": "bias", "dxy": "bias / 2", "us10y": "-bias", "macro": "(abs(bias / 2) + abs(bias)) / 2"}.get(n, n), *X.FEATURES[i][1:]) for i, n in MATCHED.items()))


@query(
    f"""WITH {ALL}, {DAILY.removeprefix(f"{BARS}, ")}, {BIAS}, mt AS (SELECT symbol, q_day, rank, last(price ORDER BY step) - first(price ORDER BY step) AS e FROM path GROUP BY 1, 2, 3),
    mf AS (SELECT symbol, q_day, avg(similarity / 100) AS hist_sim, avg(sign(e)) AS hist_consensus, avg(e) AS move FROM mt JOIN chosen USING (symbol, q_day, rank) GROUP BY 1, 2),
    mv2 AS (SELECT symbol, q_day, hist_sim, hist_consensus, move / (last_price + 1e-8) * 100 AS hist_return, bias FROM mf JOIN qs USING (symbol, q_day) JOIN bias USING (symbol)),
    mx AS (SELECT mv2.*, unnest([{_SCALED}]) AS x FROM mv2) SELECT {QD}, x[1] AS i, x[2] AS v FROM mx""".replace("x[1] AS i, x[2] AS v", "CAST(struct_extract(x, 1) AS BIGINT) AS i, struct_extract(x, 2) AS v"),
    "v",
    "",
    "i",
)
def fe12_match_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the feature vector that come from matches and outer biases, at the last bar of every matched day."""
    g, q, _, paths = paths_of(spark, sf_dir)
    ends = q.select(*P.KEY, F.col("as_of").alias("bar_ts"), F.col("last_price").alias("close"))
    told = X.match_features(paths.select(*P.KEY, "similarity", "path").join(ends, list(P.KEY)), ends)
    of_bars = X.bar_features(g.select("symbol", "bar_ts", "open", "high", "low", "close", "volume")).join(told.select("symbol", "bar_ts"), ["symbol", "bar_ts"], "left_semi")
    bias = X.trend_bias(daily_closes(spark, sf_dir)).select("symbol", F.col("bias").alias("inst"), (F.col("bias") / 2).alias("dxy"), (-F.col("bias")).alias("us10y"))
    v = X.feature_vector(of_bars, told, bias).join(ends.select(*P.KEY, "bar_ts"), ["symbol", "bar_ts"])
    return named(v, F.posexplode("features").alias("i", "v")).where(F.col("i").isin(list(MATCHED)))


ENS = "ens AS (SELECT symbol, q_day, step, sum(weight * price) AS matcher FROM path JOIN wt USING (symbol, q_day, rank) GROUP BY 1, 2, 3)"


@query(f"WITH {ALL}, {ENS} SELECT {QD}, step, matcher FROM ens", "matcher", "", "step")
def fc7_ensemble_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(P.ensemble_path(paths_of(spark, sf_dir)[3], STEPS), "step", "matcher")


SHARE_SQL = """CASE WHEN sim >= 92 THEN least(share, .65) ELSE share END"""
WEIGHTS = f"""{BARS}, w AS (SELECT symbol, bar_ts, close % 101 * .98765 AS win, (volume % 7) * 2e-5 AS mse, CASE WHEN hour(bar_ts) % 2 = 0 THEN 'TRENDING' ELSE 'RANGING' END AS regime, (close % 10) / 10 AS score, 80 + close % 20 AS sim FROM bars),
q AS (SELECT *, .7 * greatest(0, least(1, (win - 50) / 40)) + .3 * CASE WHEN mse > 0 THEN greatest(0, least(1, 1 - mse / 1e-4)) ELSE .5 END AS perf FROM w),
s AS (SELECT *, CASE WHEN regime = 'TRENDING' THEN greatest(.25, least(.85, .30 + .55 * perf + .20 * score)) ELSE greatest(.15, least(.55, .15 + .45 * perf)) END AS share FROM q)"""


@query(f"WITH {WEIGHTS} SELECT symbol, bar_ts, {SHARE_SQL} AS share FROM s", "share", "bar_ts")
def fc8_blend_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    regime = F.when(F.hour("bar_ts") % 2 == 0, "TRENDING").otherwise("RANGING")
    c = F.col("close")
    return bars(spark, sf_dir).select("symbol", "bar_ts", P.blend_weight(c % 101 * 0.98765, (F.col("volume") % 7) * 2e-5, regime, (c % 10) / 10, 80 + c % 20).alias("share"))


@query(f"WITH {ALL}, {ENS} SELECT {QD}, step, .6 * matcher + .4 * (last_price + step * .01) - .02 * step AS predicted FROM ens JOIN qs USING (symbol, q_day)", "predicted", "", "step")
def fc9_blend_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, q, _, paths = paths_of(spark, sf_dir)
    d = P.ensemble_path(paths, STEPS).join(q.select(*P.KEY, "last_price"), list(P.KEY))
    d = d.withColumns({"model": F.col("last_price") + F.col("step") * 0.01, "share": F.lit(0.4), "step_bias": 0.02 * F.col("step")})
    return named(P.blend_path(d, STEPS), "step", "predicted")


BAND = """sp AS (SELECT symbol, q_day, step, stddev_pop(r) AS s FROM pr GROUP BY 1, 2, 3),
band AS (SELECT ens.symbol, ens.q_day, step, matcher, matcher * 1.1 * greatest(s, coalesce(vol30 / (last_price + 1e-8), .0008)) * sqrt(step) * 1.5 AS w FROM ens JOIN sp USING (symbol, q_day, step) JOIN qs USING (symbol, q_day))"""


@query(f"WITH {ALL}, {ENS}, {BAND} SELECT {QD}, step, matcher + w AS upper, matcher - w AS lower FROM band", "upper lower", "", "step")
def fc10_confidence_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, q, _, paths = paths_of(spark, sf_dir)
    d = P.ensemble_path(paths, STEPS).withColumnRenamed("matcher", "predicted").join(q.select(*P.KEY, "last_price", "vol30"), list(P.KEY))
    return named(P.confidence_band(d, paths, F.lit(1.1)), "step", "upper", "lower")


@query(
    f"""WITH {ALL}, {ENS}, qq AS (SELECT symbol, q_day, step, quantile_cont(price, .1) AS lo, quantile_cont(price, .9) AS hi FROM path GROUP BY 1, 2, 3)
    SELECT {QD}, step, CAST(round(CAST(greatest(matcher + (hi - matcher) * 1.2 + .03, matcher + .05) AS DECIMAL(18, 9)), 2) AS DOUBLE) AS q_upper,
    CAST(round(CAST(least(matcher + (lo - matcher) * 1.2 - .02, matcher - .05) AS DECIMAL(18, 9)), 2) AS DOUBLE) AS q_lower FROM ens JOIN qq USING (symbol, q_day, step)""",
    "q_upper q_lower",
    "",
    "step",
)
def fc11_quantile_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = paths_of(spark, sf_dir)[3]
    d = P.ensemble_path(paths, STEPS).withColumnRenamed("matcher", "predicted")
    return named(P.quantile_band(d, paths, F.lit(1.2), F.lit(0.03), F.lit(-0.02)), "step", "q_upper", "q_lower")


EXT = """wr AS (SELECT symbol, q_day, step, sum(weight * r) AS r FROM pr JOIN wt USING (symbol, q_day, rank) GROUP BY 1, 2, 3), e AS (SELECT symbol, q_day, max(r) - 1 AS up, min(r) - 1 AS down FROM wr GROUP BY 1, 2),
sx AS (SELECT symbol, q_day, first(step ORDER BY round(matcher, 9) DESC, step) AS high_step, first(step ORDER BY round(matcher, 9), step) AS low_step FROM ens GROUP BY 1, 2),
ex AS (SELECT symbol, q_day, high_step, low_step, last_price * (1 + greatest(up, .0008)) + .1 + least(.02, last_price * .005) AS hi, last_price * (1 + least(down, -.0015)) + 0 + greatest(-.01, -last_price * .005) AS lo FROM e JOIN sx USING (symbol, q_day) JOIN qs USING (symbol, q_day))"""


@query(f"WITH {ALL}, {ENS}, {EXT} SELECT {QD}, hi AS rest_high, CASE WHEN hi - lo < 1.8 THEN hi - 2.2 ELSE lo END AS rest_low, high_step, low_step FROM ex", "rest_high rest_low", "", "high_step low_step")
def fc12_rest_of_day_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, q, _, paths = paths_of(spark, sf_dir)
    predicted = P.ensemble_path(paths, STEPS).withColumnRenamed("matcher", "predicted")
    state = q.select(*P.KEY, "last_price", F.col("last_price").alias("base"), F.lit(0.4).alias("inst_factor"), F.lit(0.02).alias("high_bias"), F.lit(-0.01).alias("low_bias"))
    return named(P.rest_of_day_extrema(paths, predicted, state), "rest_high", "rest_low", "high_step", "low_step")


@query(
    f"""WITH {BARS}, s AS (SELECT symbol, bar_ts, CAST(volume AS BIGINT) % 200 AS step FROM bars) SELECT symbol, bar_ts, CASE WHEN step <= 3 THEN 'now'
    WHEN step >= 60 THEN strftime(bar_ts + to_minutes(step), '%H:%M') || ' (in ' || (step // 60) || 'h' || lpad(CAST(step % 60 AS VARCHAR), 2, '0') || 'm)' ELSE strftime(bar_ts + to_minutes(step), '%H:%M') || ' (in ' || step || 'm)' END AS label FROM s""",
    "",
    "bar_ts",
)
def fc13_extrema_time_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = (F.col("volume").cast("long") % 200).cast("int")
    return bars(spark, sf_dir).select("symbol", "bar_ts", P.extrema_time_label(step, F.col("bar_ts")).alias("label"))


VOTES = """mr AS (SELECT symbol, q_day, rank, last(r ORDER BY step) - 1 AS e, avg(r - 1) AS m FROM pr GROUP BY 1, 2, 3),
mv2 AS (SELECT symbol, q_day, rank, CASE WHEN e > .00015 AND m > 0 THEN 'up' WHEN e < -.00015 AND m < 0 THEN 'down' ELSE 'flat' END AS v FROM mr),
votes AS (SELECT symbol, q_day, count(*) FILTER (v = 'up') AS up_votes, count(*) FILTER (v = 'down') AS down_votes, count(*) FILTER (v = 'flat') AS flat_votes, coalesce(sum(weight) FILTER (v = 'up'), 0) AS up_weight,
  coalesce(sum(weight) FILTER (v = 'down'), 0) AS down_weight, coalesce(sum(weight) FILTER (v = 'flat'), 0) AS flat_weight, avg(similarity) AS mean_sim FROM mv2 JOIN wt USING (symbol, q_day, rank) GROUP BY 1, 2)"""


@query(f"WITH {ALL}, {VOTES} SELECT {QD}, up_votes, down_votes, flat_votes, up_weight, down_weight, flat_weight FROM votes", "up_weight down_weight flat_weight", "", "up_votes down_votes flat_votes")
def fc14_direction_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(P.direction_votes(paths_of(spark, sf_dir)[3]), "up_votes", "down_votes", "flat_votes", "up_weight", "down_weight", "flat_weight")


@query(
    f"""WITH {ALL}, {VOTES}, c AS (SELECT *, greatest(up_weight, down_weight, flat_weight) AS most, CAST(round(CAST(.5 * greatest(up_weight, down_weight, flat_weight) + .35 * mean_sim / 100 + .15 * .7 AS DECIMAL(18, 9)), 3) AS DOUBLE) AS c, CAST(up_votes AS INT) - CAST(down_votes AS INT) AS res FROM votes)
    SELECT {QD}, CASE WHEN res <> 0 THEN greatest(.85, least(.98, c + .2)) ELSE c END AS confidence, CASE WHEN res > 0 THEN 'bull resonance' WHEN res < 0 THEN 'bear resonance' WHEN most = up_weight AND c >= .55 THEN 'bull' WHEN most = down_weight AND c >= .55 THEN 'bear' ELSE 'mixed' END AS label FROM c""",
    "confidence",
)
def fc15_direction_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = P.direction_votes(paths_of(spark, sf_dir)[3])
    return named(P.direction_confidence(votes, F.lit(70.0), F.col("up_votes") - F.col("down_votes")), "confidence", "label")


def advice_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of the advice rules from bars; prices are noise, so every rule is met."""
    c, v = F.col("close"), F.col("volume")
    d = bars(spark, sf_dir)
    label = F.element_at(F.array(*[F.lit(x) for x in ("bull", "bear", "mixed", "mixed", "bull resonance", "bear resonance")]), (v.cast("long") % 6 + 1).cast("int"))
    return d.select(
        "symbol", F.col("bar_ts").alias("q_trading_date"), ((c * 7) % 100 / 100).alias("position"), ((c * 3) % 1 - 0.5).alias("slope_15"), label.alias("label"), ((c * 5) % 1 - 0.5).alias("delta"),
        (60 + c % 40).alias("top1_sim"), ((c * 11) % 1).alias("top1_delta"), ((c * 13) % 1).alias("confidence"), (v.cast("long") % 25 + 1).cast("int").alias("high_step"), ((c * 17) % 5).alias("upside"), ((c * 19) % 5).alias("downside"),
    )


ADVICE_IN = f"""{BARS}, a0 AS (SELECT symbol, bar_ts, (close * 7) % 100 / 100 AS pos, (close * 3) % 1 - .5 AS slope, (['bull', 'bear', 'mixed', 'mixed', 'bull resonance', 'bear resonance'])[CAST(volume AS BIGINT) % 6 + 1] AS label, (close * 5) % 1 - .5 AS delta,
  60 + close % 40 AS sim, (close * 11) % 1 AS t1, (close * 13) % 1 AS conf, CAST(volume AS BIGINT) % 25 + 1 AS peak, (close * 17) % 5 AS up FROM bars),
a1 AS (SELECT *, slope >= .15 OR label LIKE 'bull%' AS rising FROM a0), a2 AS (SELECT *, NOT rising AND (slope < -.15 OR delta < -.25 OR label LIKE 'bear%') AS falling FROM a1),
a3 AS (SELECT *, CASE WHEN falling THEN CASE WHEN pos >= .75 THEN 'STRONG_SELL' WHEN pos >= .4 THEN 'SELL_RISK' ELSE 'WAIT' END
  WHEN rising THEN CASE WHEN pos <= .5 THEN 'STRONG_BUY' WHEN pos <= .85 THEN 'BUY_DIP' ELSE 'WAIT' END
  WHEN sim >= 80 AND t1 > .4 AND pos <= .85 THEN CASE WHEN pos <= .4 OR conf >= .7 THEN 'STRONG_BUY' ELSE 'BUY_DIP' END
  WHEN pos <= .35 AND delta >= .05 THEN CASE WHEN pos <= .2 THEN 'STRONG_BUY' ELSE 'BUY_DIP' END WHEN pos > .35 AND pos <= .75 AND delta >= .05 THEN 'BUY_DIP' WHEN pos > .85 AND delta < -.1 AND slope <= 0 THEN 'SELL_RISK' ELSE 'WAIT' END AS a FROM a2),
a4 AS (SELECT * REPLACE (CASE WHEN rising OR slope > .1 THEN CASE WHEN a IN ('SELL_RISK', 'STRONG_SELL') THEN CASE WHEN pos <= .85 THEN 'BUY_DIP' ELSE 'WAIT' END ELSE a END
  WHEN peak BETWEEN 5 AND 15 AND pos >= .75 AND slope <= .05 THEN CASE WHEN a IN ('BUY_DIP', 'WAIT') THEN 'SELL_RISK' ELSE a END WHEN peak <= 5 AND pos >= .85 AND delta < 0 AND slope < 0 THEN 'STRONG_SELL' ELSE a END AS a) FROM a3),
a5 AS (SELECT * REPLACE (CASE WHEN up < 3 AND a = 'STRONG_BUY' THEN 'BUY_DIP' ELSE a END AS a) FROM a4), a6 AS (SELECT * REPLACE (CASE WHEN up < 1.2 AND a = 'BUY_DIP' THEN 'WAIT' ELSE a END AS a) FROM a5)"""


@query(
    f"""WITH {BARS}, x AS (SELECT symbol, bar_ts, close, high + 1 AS hi, low - .5 AS lo FROM bars) SELECT symbol, bar_ts, greatest(0, least(1, (close - lo) / greatest(hi - lo, 1.8))) AS position, greatest(0, hi - close) AS upside, greatest(0, close - lo) AS downside,
    CAST(round(CAST(greatest(0, hi - close) / greatest(greatest(0, close - lo), .05) AS DECIMAL(18, 9)), 2) AS DOUBLE) AS reward_risk FROM x""",
    "position upside downside reward_risk",
    "bar_ts",
)
def fc16_channel_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bars(spark, sf_dir).select("symbol", "bar_ts", F.col("close").alias("last_price"), (F.col("high") + 1).alias("rest_high"), (F.col("low") - 0.5).alias("rest_low"))
    return P.channel_position(d).select("symbol", "bar_ts", "position", "upside", "downside", "reward_risk")


@query(f"WITH {ADVICE_IN} SELECT symbol, bar_ts, a AS advice_raw FROM a6", "", "bar_ts")
def fc17_raw_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.raw_advice(advice_inputs(spark, sf_dir)).select("symbol", F.col("q_trading_date").alias("bar_ts"), "advice_raw")


@query(
    f"""WITH RECURSIVE {ADVICE_IN}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS n FROM a6),
    s AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS n, CAST(NULL AS TIMESTAMP) AS bar_ts, 'WAIT' AS advice FROM o UNION ALL
      SELECT o.symbol, o.n, o.bar_ts, CASE WHEN (s.advice = 'STRONG_BUY' AND x.b = 'STRONG_SELL') OR (s.advice = 'STRONG_SELL' AND x.b = 'STRONG_BUY') THEN 'WAIT' ELSE x.b END
      FROM s JOIN o ON o.symbol = s.symbol AND o.n = s.n + 1, LATERAL (SELECT CASE WHEN s.advice IN ('STRONG_BUY', 'BUY_DIP') AND o.up >= 2.5 AND o.pos <= .85 AND o.peak > 15 AND o.a IN ('SELL_RISK', 'STRONG_SELL') THEN 'BUY_DIP' ELSE o.a END AS b) x)
    SELECT symbol, bar_ts, advice FROM s WHERE n > 0""",
    "",
    "bar_ts",
)
def fc18_advice_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 100 rows, so that maps are composed across many of them."""
    return P.advice_state(P.raw_advice(advice_inputs(spark, sf_dir)), chunk=100).select("symbol", F.col("q_trading_date").alias("bar_ts"), "advice")


@query(
    f"""WITH {ADVICE_IN}, x AS (SELECT a6.*, (b.close * 19) % 5 AS down FROM a6 JOIN bars b USING (symbol, bar_ts)) SELECT symbol, bar_ts, CASE a WHEN 'STRONG_BUY' THEN 'buy' WHEN 'BUY_DIP' THEN 'buy dips' WHEN 'SELL_RISK' THEN 'reduce' WHEN 'STRONG_SELL' THEN 'sell' ELSE 'wait' END AS action,
    '30 to 60 minutes' AS time_window, CASE WHEN a IN ('STRONG_BUY', 'BUY_DIP') THEN '+' WHEN a = 'WAIT' THEN '+-' ELSE '-' END AS sign FROM x""",
    "",
    "bar_ts",
)
def fc19_advice_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.raw_advice(advice_inputs(spark, sf_dir)).withColumnRenamed("advice_raw", "advice").withColumns({"rest_high": F.lit(10.0), "rest_low": F.lit(1.0), "reward_risk": F.lit(1.0)})
    r = P.advice_record(d, N)
    return r.select("symbol", F.col("q_trading_date").alias("bar_ts"), "record.action", "record.time_window", F.regexp_extract("record.expected_profit", "^([+-]+)", 1).alias("sign"))


#: Steps of the short and the long forecast.
HORIZONS = {"short": STEPS, "long": N}


def forecasts(spark: SparkSession, g: DataFrame, sf_dir: str, horizons: dict[str, int] | None = None) -> DataFrame:
    """A forecast of each horizon for every day of the grid ``g``, from earlier days and what was known at its last bar:
    matches whose future is past, scores and biases of resolved predictions, and the model that had learned their returns
    from inputs with the matches of the day."""
    horizons = horizons or HORIZONS
    g = settled(P.placed(g), "placed")
    w = settled(M.day_windows(g, N), "windows")
    q = settled(P.query_prices(g, w, N), "queries")
    every = settled(M.match_days(g, N, radius=23, past_only=True), "matches")
    inputs = None
    for name, steps in horizons.items():
        m = every.where(F.col("h_start_pos") + steps <= F.col("q_start_pos"))
        if inputs is None:  # the model's inputs have the first horizon's matches
            paths = P.project_path(P.vol_ratio(P.match_future(P.softmax_weights(m), g, N, steps), g, q, N), steps)
            ends = q.select(*P.KEY, F.col("as_of").alias("bar_ts"), F.col("last_price").alias("close"))
            told = X.match_features(paths.select(*P.KEY, "similarity", "path").join(ends, list(P.KEY)), ends)
            of_bars = X.bar_features(g.select("symbol", "bar_ts", "open", "high", "low", "close", "volume")).join(ends.select("symbol", "bar_ts"), ["symbol", "bar_ts"], "left_semi")
            of_bars = settled(of_bars, "features")
            vectors = X.feature_vector(of_bars, matches=told).join(ends.select(*P.KEY, "bar_ts"), ["symbol", "bar_ts"])
            inputs = settled(vectors.join(of_bars.select("symbol", "bar_ts", "imbalance"), ["symbol", "bar_ts"]).select(*P.KEY, "features", "imbalance"), "inputs")
            known, said = feedback(spark, sf_dir, q, inputs)
            out = None
        f = P.generate_forecast(g, w, m, N, steps, known, P.model_path(said, q, steps), minutes=60).withColumn("horizon", F.lit(name))
        out = f if out is None else out.unionByName(f)
    return out


@query()
def fc20_generate_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = dated(forecasts(spark, settled(grid(spark, sf_dir), "grid"), sf_dir))
    ends = [F.element_at(c, -1).alias(f"{c}_end") for c in ("predicted", "upper", "lower", "q_upper", "q_lower")]
    return f.select("symbol", "q_trading_date", "horizon", "last_price", "valid_count", "confidence", "label", *ends, "rest_high", "rest_low", "high_time", "low_time", "regime", "advice")


#: Chosen from earlier days, of which those whose future is past at the query's last bar are used.
PAST = f"{WIN}, {pairs_cte(N, past=True)}, {nms_cte(23)}".replace("chosen AS (", "chosen0 AS (") + f", chosen AS (SELECT c.* FROM chosen0 c JOIN win w ON w.symbol = c.symbol AND w.day = c.q_day WHERE c.start_pos + {STEPS} <= w.start_pos)"
REPLAY = f"""rs AS (SELECT ens.symbol, ens.q_day, ens.step, matcher, p.close AS actual, last_price, p.bar_ts, l.bar_ts AS as_of FROM ens JOIN qs USING (symbol, q_day) JOIN pos p ON p.symbol = ens.symbol AND p.p = q_pos + {N - 1} + step JOIN pos l ON l.symbol = ens.symbol AND l.p = q_pos + {N - 1}),
full_days AS (SELECT symbol, q_day, max(bar_ts) AS known_at, max(as_of) AS as_of, row_number() OVER (PARTITION BY symbol ORDER BY max(bar_ts)) AS k FROM rs GROUP BY 1, 2 HAVING count(*) = {STEPS}),
er AS (SELECT rs.*, known_at, k FROM rs JOIN full_days USING (symbol, q_day)),
bs AS (SELECT symbol, step, k, known_at, .25 * (matcher - actual) AS x FROM er WHERE k = 1 UNION ALL SELECT e.symbol, e.step, e.k, e.known_at, .75 * b.x + .25 * (e.matcher - e.actual) FROM bs b JOIN er e ON e.symbol = b.symbol AND e.step = b.step AND e.k = b.k + 1),
cr AS (SELECT er.symbol, er.q_day, er.step, matcher, actual, last_price, matcher - coalesce(x, 0) AS corrected FROM er ASOF LEFT JOIN bs ON bs.symbol = er.symbol AND bs.step = er.step AND bs.known_at <= er.as_of)"""


@query(
    f"""WITH RECURSIVE {PAST}, {WT}, {ST}, {PATH}, {ENS}, {REPLAY} SELECT symbol, strftime(q_day, '%Y-%m-%d') AS q_trading_date, last_price, last(matcher ORDER BY step) AS predicted_end, last(actual ORDER BY step) AS actual_end, avg(abs(matcher - actual) / actual) * 100 AS mape,
    last(corrected ORDER BY step) AS corrected_end, avg(abs(corrected - actual) / actual) * 100 AS corrected_mape FROM cr GROUP BY 1, 2, 3""",
    "last_price predicted_end actual_end mape corrected_end corrected_mape",
)
def bt1_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day of the grid as a cut-off, with the corrections learned from the cut-offs before it."""
    return dated(B.backtest(grid(spark, sf_dir), N, STEPS, radius=23, replay=True))
