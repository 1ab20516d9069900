"""Queries of the smoothing and feature operators over hourly bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.operators import features as X
from barweave.registry import query
from barweave.sources.events import BARS, bars

W = "WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)"
D = f"{BARS}, d AS (SELECT *, row_number() OVER w AS n, close - lag(close) OVER w AS diff, (close - lag(close) OVER w) / (lag(close) OVER w + 1e-8) AS r FROM bars {W})"


def frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def shown(df: DataFrame, *cols: str) -> DataFrame:
    return df.select("symbol", "bar_ts", *cols)


@query(
    f"""WITH {BARS}, s AS (SELECT symbol, time_bucket(INTERVAL '4 hours', bar_ts) AS ts, first(open ORDER BY bar_ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY bar_ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2)
    SELECT symbol, ts AS bar_ts, close, CAST(round(CAST(coalesce(.1 * lag(close, 2) OVER w + .2 * lag(close) OVER w + .4 * close + .2 * lead(close) OVER w + .1 * lead(close, 2) OVER w, close) AS DECIMAL(18, 9)), 2) AS DOUBLE) AS close_smooth,
    coalesce((epoch(ts) - epoch(lag(ts) OVER w)) / 60 > 300, FALSE) AS is_gap FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
    "close close_smooth",
    "bar_ts",
)
def fe1_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(X.skeleton(bars(spark, sf_dir), "4 hours", gap=300.0), "close", "close_smooth", "is_gap")


@query(
    f"""WITH {BARS} SELECT symbol, bar_ts, CASE WHEN count(*) OVER f = 5 THEN avg(close) OVER f ELSE close END AS smooth FROM bars
    WINDOW f AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    "smooth",
    "bar_ts",
)
def fe2_smooth_boxcar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(X.smooth_boxcar(bars(spark, sf_dir)), "smooth")


@query(f"WITH {D} SELECT symbol, bar_ts, CASE WHEN n < 14 THEN 50.0 ELSE 100 - 100 / (1 + avg(greatest(coalesce(diff, 0), 0)) OVER f / (avg(greatest(-coalesce(diff, 0), 0)) OVER f + 1e-8)) END AS rsi FROM d WINDOW f AS {frame(14)}", "rsi", "bar_ts")
def fe3_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(X.apply(bars(spark, sf_dir), X.rsi(), behind=14), "rsi")


@query(
    f"""WITH RECURSIVE {D}, e AS (SELECT symbol, bar_ts, n, close AS num, CAST(1 AS DOUBLE) AS den, close FROM d WHERE n = 1
    UNION ALL SELECT d.symbol, d.bar_ts, d.n, e.num * (1 - 2.0 / 21) + d.close, e.den * (1 - 2.0 / 21) + 1, d.close FROM e JOIN d ON d.symbol = e.symbol AND d.n = e.n + 1)
    SELECT symbol, bar_ts, num / den AS ema, (close - num / den) / (num / den + 1e-8) * 100 AS ema_dist FROM e""",
    "ema ema_dist",
    "bar_ts",
)
def fe4_ewm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(X.ewm(bars(spark, sf_dir)), "ema", "ema_dist")


@query(f"WITH {BARS} SELECT symbol, bar_ts, avg(greatest(high - low, 1e-4)) OVER f / (close + 1e-8) * 100 AS atr FROM bars WINDOW f AS {frame(14)}", "atr", "bar_ts")
def fe5_atr_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(X.apply(bars(spark, sf_dir), X.atr_pct(), behind=14), "atr")


def pct(k: int) -> str:
    return f"coalesce((close - lag(close, {k}) OVER w) / (lag(close, {k}) OVER w + 1e-8) * 100, 0)"


@query(f"WITH {BARS} SELECT symbol, bar_ts, {pct(3)} AS mom3, {pct(6)} AS mom6, {pct(14)} AS slope15, {pct(3)} - {pct(6)} AS mom_accel FROM bars {W}", "mom3 mom6 slope15 mom_accel", "bar_ts")
def fe6_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(X.apply(bars(spark, sf_dir), X.momentum(), behind=14), "mom3", "mom6", "slope15", "mom_accel")


@query(
    f"""WITH {D}, v AS (SELECT symbol, bar_ts, sum(CASE WHEN diff > 0 THEN volume ELSE 0 END) OVER f AS up, sum(CASE WHEN diff < 0 THEN volume ELSE 0 END) OVER f AS down FROM d WINDOW f AS {frame(14)})
    SELECT symbol, bar_ts, (up - down) / (up + down + 1e-8) AS vol_imb FROM v""",
    "vol_imb",
    "bar_ts",
)
def fe7_volume_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(X.apply(bars(spark, sf_dir), X.volume_direction(), behind=15), "vol_imb")


@query(f"WITH {BARS}, v AS (SELECT symbol, bar_ts, close, sum(close * volume) OVER f / (sum(volume) OVER f + 1e-8) AS vwap FROM bars WINDOW f AS {frame(20)}) SELECT symbol, bar_ts, vwap, (close - vwap) / (vwap + 1e-8) * 100 AS vwap_bias FROM v", "vwap vwap_bias", "bar_ts")
def fe8_vwap_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(X.apply(bars(spark, sf_dir), X.vwap_dev(), behind=20), "vwap", "vwap_bias")


@query(f"WITH {D} SELECT symbol, bar_ts, coalesce(avg(sign(diff) * volume) OVER f, 0) / (avg(volume) OVER f + 1e-8) AS obv_slope FROM d WINDOW f AS {frame(9)}", "obv_slope", "bar_ts")
def fe9_obv_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(X.apply(bars(spark, sf_dir), X.obv_slope(), behind=10), "obv_slope")


@query(f"WITH {D} SELECT symbol, bar_ts, coalesce(stddev_pop(r) OVER {frame(4)}, 0) AS vol5, coalesce(stddev_pop(r) OVER {frame(14)}, 0) AS vol15 FROM d", "vol5 vol15", "bar_ts")
def fe10_vol_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(X.apply(bars(spark, sf_dir), X.vol_cluster(), behind=15), "vol5", "vol15")


@query(f"WITH {BARS} SELECT symbol, bar_ts, (close - min(close) OVER f) / (max(close) OVER f - min(close) OVER f + 1e-8) AS range60 FROM bars WINDOW f AS {frame(60)}", "range60", "bar_ts")
def fe11_range_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(X.apply(bars(spark, sf_dir), X.range_position(), behind=60), "range60")


def _z(value: str, mean: float, sd: float) -> str:
    return f"greatest(-3, least(3, (({value}) - {mean}) / ({sd} + 1e-8)))"


_FE12 = f"""WITH RECURSIVE {D}, e AS (SELECT symbol, n, close AS num, CAST(1 AS DOUBLE) AS den FROM d WHERE n = 1
  UNION ALL SELECT d.symbol, d.n, e.num * (1 - 2.0 / 21) + d.close, e.den * (1 - 2.0 / 21) + 1 FROM e JOIN d ON d.symbol = e.symbol AND d.n = e.n + 1),
f AS (SELECT d.symbol, d.bar_ts, d.n, close, num / den AS ema,
  CASE WHEN d.n < 14 THEN 50.0 ELSE 100 - 100 / (1 + avg(greatest(coalesce(diff, 0), 0)) OVER f14 / (avg(greatest(-coalesce(diff, 0), 0)) OVER f14 + 1e-8)) END AS rsi,
  avg(greatest(high - low, 1e-4)) OVER f14 / (close + 1e-8) * 100 AS atr, {pct(3)} AS mom3, {pct(6)} AS mom6, {pct(14)} AS slope15,
  sum(CASE WHEN diff > 0 THEN volume ELSE 0 END) OVER f14 AS up, sum(CASE WHEN diff < 0 THEN volume ELSE 0 END) OVER f14 AS down,
  sum(close * volume) OVER f20 / (sum(volume) OVER f20 + 1e-8) AS vwap,
  coalesce(avg(sign(diff) * volume) OVER f9, 0) / (avg(volume) OVER f9 + 1e-8) AS obv,
  coalesce(stddev_pop(r) OVER f4, 0) AS vol5, coalesce(stddev_pop(r) OVER f14, 0) AS vol15,
  (close - min(close) OVER f60) / (max(close) OVER f60 - min(close) OVER f60 + 1e-8) AS range60
  FROM d JOIN e ON e.symbol = d.symbol AND e.n = d.n
  WINDOW w AS (PARTITION BY d.symbol ORDER BY d.bar_ts), f4 AS (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), f9 AS (w ROWS BETWEEN 8 PRECEDING AND CURRENT ROW),
  f14 AS (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), f20 AS (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), f60 AS (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
z AS (SELECT symbol, bar_ts, n, [{_z('(rsi - 50) / 50', 0, .5)}, {_z('(close - ema) / (ema + 1e-8) * 100', 0, .15)}, {_z('atr', .05, .04)}, {_z('mom3', 0, .08)}, {_z('mom6', 0, .12)},
  {_z('slope15', 0, .15)}, {_z('(up - down) / (up + down + 1e-8)', 0, .5)}, 0, {_z('0.7', .7, .15)}, 0, 0, {_z('(close - vwap) / (vwap + 1e-8) * 100', 0, .1)}, {_z('obv', 0, .5)},
  {_z('vol5', .02, .02)}, {_z('vol15', .05, .03)}, {_z('range60', .5, .25)}, {_z('mom3 - mom6', 0, .1)}, 0, 0, 0] AS v FROM f)
SELECT symbol, bar_ts, unnest(range(20)) AS i, unnest(CASE WHEN n >= 20 THEN v ELSE list_transform(v, lambda x: CAST(0 AS DOUBLE)) END) AS v FROM z"""
_FE12 = _FE12.replace("(w ROWS BETWEEN", "(PARTITION BY d.symbol ORDER BY d.bar_ts ROWS BETWEEN")


@query(_FE12, "v", "bar_ts", "i")
def fe12_feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.feature_vector(X.bar_features(bars(spark, sf_dir)))
    return v.select("symbol", "bar_ts", F.posexplode("features").alias("i", "v"))


@query(
    f"""WITH {BARS}, f AS (SELECT symbol, bar_ts, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS n, (close - open) * coalesce(volume, 1) AS x FROM bars),
    s AS (SELECT symbol, bar_ts, n, sum(greatest(x, 0)) OVER w AS b, sum(greatest(-x, 0)) OVER w AS s FROM f WINDOW w AS {frame(30)})
    SELECT symbol, bar_ts, CASE WHEN n >= 5 THEN CAST(round(CAST(greatest(-1, least(1, (b - s) / (b + s + 1e-8))) AS DECIMAL(18, 9)), 3) AS DOUBLE) ELSE 0.0 END AS imbalance FROM s""",
    "imbalance",
    "bar_ts",
)
def fe13_volume_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(X.apply(bars(spark, sf_dir), X.volume_imbalance(), behind=30), "imbalance")


DAILY = f"{BARS}, daily AS (SELECT symbol, CAST(bar_ts AS DATE) AS day, last(close ORDER BY bar_ts) AS close FROM bars GROUP BY 1, 2)"
BIAS = """bias AS (SELECT symbol, CASE WHEN count(*) >= 2 THEN greatest(-1, least(1, regr_slope(close, CAST(-k AS DOUBLE)) / last(close ORDER BY k) * 200)) ELSE 0 END AS bias
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k FROM daily) WHERE k <= 5 GROUP BY 1)"""


def daily_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).groupBy("symbol", F.to_date("bar_ts").alias("day")).agg(F.max_by("close", "bar_ts").alias("close"))


@query(f"WITH {DAILY}, {BIAS} SELECT symbol, bias FROM bias", "bias")
def fe14_trend_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.trend_bias(daily_closes(spark, sf_dir))


@query(
    f"""WITH {DAILY}, {BIAS}, f AS (SELECT symbol, bar_ts, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS n, (close - open) * coalesce(volume, 1) AS x FROM bars),
    s AS (SELECT symbol, bar_ts, n, sum(greatest(x, 0)) OVER w AS b, sum(greatest(-x, 0)) OVER w AS s FROM f WINDOW w AS {frame(30)})
    SELECT symbol, bar_ts, greatest(-1, least(1, .6 * bias + .4 * CASE WHEN n >= 5 THEN CAST(round(CAST(greatest(-1, least(1, (b - s) / (b + s + 1e-8))) AS DECIMAL(18, 9)), 3) AS DOUBLE) ELSE 0.0 END)) AS inst_factor FROM s JOIN bias USING (symbol)""",
    "inst_factor",
    "bar_ts",
)
def fe15_institution_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.apply(bars(spark, sf_dir), X.volume_imbalance(), behind=30).join(X.trend_bias(daily_closes(spark, sf_dir)), "symbol")
    return shown(d.withColumn("inst_factor", X.institution_factor(F.col("bias"), F.col("imbalance"))), "inst_factor")


REGIME = f"""g AS (SELECT symbol, bar_ts, n, CASE WHEN n >= 30 THEN greatest(0, least(1, stddev_pop(r) OVER {frame(29)} * 1200 + abs((close - lag(close, 29) OVER w) / (lag(close, 29) OVER w + 1e-8)) * 250)) ELSE 0.5 END AS regime_score FROM d {W})"""


@query(f"WITH {D}, {REGIME} SELECT symbol, bar_ts, regime_score, CASE WHEN n >= 30 AND regime_score > .45 THEN 'TRENDING' ELSE 'RANGING' END AS regime FROM g", "regime_score", "bar_ts")
def fe16_market_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(X.apply(bars(spark, sf_dir), X.market_regime(), behind=30), "regime_score", "regime")


@query(
    f"""WITH RECURSIVE {D}, k AS (SELECT d.symbol, d.bar_ts, d.n AS upto, greatest(1, d.n - 14) AS i, o.close AS x, CAST(1 AS DOUBLE) AS p FROM d JOIN d o ON o.symbol = d.symbol AND o.n = greatest(1, d.n - 14) WHERE d.n >= 5
    UNION ALL SELECT k.symbol, k.bar_ts, k.upto, k.i + 1, k.x + (k.p + 1e-4) / (k.p + 1e-4 + 1e-2) * (d.close - k.x), (1 - (k.p + 1e-4) / (k.p + 1e-4 + 1e-2)) * (k.p + 1e-4) FROM k JOIN d ON d.symbol = k.symbol AND d.n = k.i WHERE k.i <= k.upto)
    SELECT symbol, bar_ts, x AS kalman FROM k WHERE i = upto + 1 UNION ALL SELECT symbol, bar_ts, close FROM d WHERE n < 5""",
    "kalman",
    "bar_ts",
)
def fe17_kalman_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(X.apply(bars(spark, sf_dir), X.kalman_level(), behind=15), "kalman")


@query(f"WITH {D} SELECT symbol, bar_ts, CASE WHEN n >= 5 THEN avg(abs(diff)) OVER {frame(29)} ELSE .2 END AS abs_move FROM d", "abs_move", "bar_ts")
def fe18_recent_abs_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(X.apply(bars(spark, sf_dir), X.recent_abs_move(), behind=30), "abs_move")


@query(
    f"""WITH {BARS}, s AS (SELECT symbol, bar_ts, sign(close - lag(close, 2) OVER w) AS a, sign(close - lag(close, 9) OVER w) AS b, sign(close - lag(close, 29) OVER w) AS c FROM bars {W})
    SELECT symbol, bar_ts, CASE WHEN a = b AND b = c THEN a ELSE 0 END AS resonance FROM s""",
    "",
    "bar_ts",
    "resonance",
)
def fe19_resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(X.apply(bars(spark, sf_dir), X.resonance(), behind=30), "resonance")


@query(f"WITH {BARS} SELECT symbol, bar_ts, coalesce(close - lag(close, 14) OVER w, 0) AS slope_15, coalesce(close - lag(close, 4) OVER w, 0) AS slope_5 FROM bars {W}", "slope_15 slope_5", "bar_ts")
def fe20_short_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(X.apply(bars(spark, sf_dir), X.short_slopes(), behind=15), "slope_15", "slope_5")
