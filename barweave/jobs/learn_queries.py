"""Queries of evaluation, the online model and the backtest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.functions.scratch import settled
from barweave.functions.windows import with_position
from barweave.operators import backtest as B
from barweave.operators import evaluation as E
from barweave.operators import features as X
from barweave.operators import feedback as V
from barweave.operators import model as L
from barweave.registry import query
from barweave.sources.events import BARS, bars

OHLCV = ("open", "high", "low", "close", "volume")
ADVICE = ("STRONG_BUY", "BUY_DIP", "WAIT", "SELL_RISK", "STRONG_SELL", "NEUTRAL")
PRED = f"""{BARS}, pr0 AS (SELECT symbol, bar_ts, bar_ts + INTERVAL 6 HOUR AS target_time, close AS base_price, close + (close - lag(close) OVER (PARTITION BY symbol ORDER BY bar_ts)) / 2 AS predicted_price,
  (['{"', '".join(ADVICE)}'])[CAST(volume AS BIGINT) % 6 + 1] AS advice_type FROM bars),
pred AS (SELECT *, predicted_price * .9 AS lower_bound, predicted_price * 1.1 AS upper_bound, CASE WHEN abs(predicted_price - base_price) <= .15 THEN 'FLAT' WHEN predicted_price > base_price THEN 'UP' ELSE 'DOWN' END AS predicted_direction
  FROM pr0 WHERE predicted_price IS NOT NULL AND predicted_price <> 0 AND base_price <> 0)"""
#: As of a day and a half before the last bar; its session began at 06:00.  The last hour's predictions are newly due.
NOW = "nw AS (SELECT max(bar_ts) - INTERVAL 36 HOUR AS now FROM bars), nws AS (SELECT now, date_trunc('day', now - INTERVAL 6 HOUR) + INTERVAL 6 HOUR AS start FROM nw)"
RES = f"""{NOW}, pp AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS p FROM bars),
res AS (SELECT d.*, b.close AS actual_price, b.p FROM pred d ASOF JOIN pp b ON d.symbol = b.symbol AND b.bar_ts >= d.target_time WHERE d.target_time <= (SELECT now FROM nws))"""
SCORED = """sc0 AS (SELECT *, actual_price - base_price AS ch, CASE WHEN abs(actual_price - base_price) <= .15 THEN 'FLAT' WHEN actual_price > base_price THEN 'UP' ELSE 'DOWN' END AS ad FROM res),
scored AS (SELECT *, CAST(ad = predicted_direction OR ad = 'FLAT' OR predicted_direction = 'FLAT' OR abs(ch) <= .25 AS INT) AS is_direction_correct, CAST(actual_price BETWEEN lower_bound AND upper_bound AS INT) AS is_range_correct,
  CAST(CASE advice_type WHEN 'STRONG_BUY' THEN ch >= .1 WHEN 'BUY_DIP' THEN ch >= -.05 WHEN 'STRONG_SELL' THEN ch <= -.1 WHEN 'SELL_RISK' THEN ch <= .05 WHEN 'WAIT' THEN abs(ch) <= .8 ELSE ad = predicted_direction OR ad = 'FLAT' END AS INT) AS is_advice_correct FROM sc0)"""
ALL = f"{PRED}, {RES}, {SCORED}"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One naive forecast for every bar, six hours ahead."""
    advice = F.element_at(F.array(*[F.lit(a) for a in ADVICE]), (F.col("volume").cast("long") % 6 + 1).cast("int"))
    step = lambda d, w: d.withColumn("predicted_price", F.col("close") + (F.col("close") - F.lag("close").over(w)) / 2)
    d = X.apply(bars(spark, sf_dir), step, behind=1)
    d = d.select("symbol", F.col("bar_ts").alias("created_at"), (F.col("bar_ts") + F.expr("INTERVAL 6 HOURS")).alias("target_time"), F.col("close").alias("base_price"), "predicted_price", advice.alias("advice_type"))
    d = d.withColumns({"lower_bound": F.col("predicted_price") * 0.9, "upper_bound": F.col("predicted_price") * 1.1})
    return E.make_predictions(d)


def as_of(spark: SparkSession, sf_dir: str) -> tuple[Column, Column]:
    """The as-of time and the start of its session, from the last bar."""
    now = F.lit(bars(spark, sf_dir).agg(F.max("bar_ts") - F.expr("INTERVAL 36 HOURS")).first()[0]).cast("timestamp")
    return now, F.date_trunc("day", now - F.expr("INTERVAL 6 HOURS")) + F.expr("INTERVAL 6 HOURS")


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumn("actual_price", F.lit(None).cast("double"))
    return settled(E.resolve_actuals(p, bars(spark, sf_dir), as_of(spark, sf_dir)[0]), "resolved")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.score_predictions(resolved(spark, sf_dir))


@query(f"WITH {PRED} SELECT symbol, target_time, base_price, predicted_price, predicted_direction FROM pred", "base_price predicted_price", "target_time")
def ev1_make_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("symbol", "target_time", "base_price", "predicted_price", "predicted_direction")


@query(
    f"""WITH {PRED}, {RES} SELECT r.symbol, target_time, actual_price, count(n.close) AS n_closes, last(n.close ORDER BY n.p) AS last_close FROM res r JOIN pp n ON n.symbol = r.symbol AND n.p BETWEEN r.p AND r.p + 5 GROUP BY 1, 2, 3""",
    "actual_price last_close",
    "target_time",
    "n_closes",
)
def ev2_resolve_actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolved(spark, sf_dir).where("actual_price is not null")
    return r.select("symbol", "target_time", "actual_price", F.size("closes").alias("n_closes"), F.element_at("closes", -1).alias("last_close"))


@query(f"WITH {ALL} SELECT symbol, target_time, is_direction_correct, is_range_correct, is_advice_correct FROM scored", "", "target_time", "is_direction_correct is_range_correct is_advice_correct")
def ev3_score_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("symbol", "target_time", "is_direction_correct", "is_range_correct", "is_advice_correct")


WIN = f"""{ALL}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY target_time DESC) AS k, target_time >= start AS td, count(*) FILTER (target_time >= start) OVER (PARTITION BY symbol) AS n,
  count(*) FILTER (target_time > now - INTERVAL 1 HOUR) OVER (PARTITION BY symbol) AS due FROM scored, nws),
win AS (SELECT symbol, count(*) AS n, 100 * (.5 * avg(is_direction_correct) + .3 * avg(is_advice_correct) + .2 * avg(is_range_correct)) AS win_rate FROM k WHERE CASE WHEN due = 0 THEN k <= 20 WHEN n >= 5 THEN td ELSE k <= 30 END GROUP BY 1)"""


def rates_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, start = as_of(spark, sf_dir)
    done = scored(spark, sf_dir)
    return E.win_rate(done, start, due=done.where(F.col("target_time") > now - F.expr("INTERVAL 1 HOUR")))


@query(f"WITH {WIN} SELECT * FROM win", "win_rate", "", "n")
def ev4_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates_of(spark, sf_dir)


@query(f"WITH {WIN} SELECT symbol, CAST(round(CAST(greatest(.9, least(1.4, .9 + .5 / (1 + exp((win_rate - 60) / 10)))) AS DECIMAL(18, 9)), 2) AS DOUBLE) AS k FROM win", "k")
def ev5_dynamic_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates_of(spark, sf_dir).select("symbol", E.dynamic_k(F.col("win_rate")).alias("k"))


NEXT = """nx AS (SELECT r.symbol, r.target_time, r.base_price, r.predicted_price, r.actual_price, n.p - r.p + 1 AS step, n.close, lag(n.close) OVER (PARTITION BY r.symbol, r.target_time ORDER BY n.p) AS before, count(*) OVER (PARTITION BY r.symbol, r.target_time) AS m
  FROM res r JOIN pp n ON n.symbol = r.symbol AND n.p BETWEEN r.p AND r.p + 5)"""


@query(
    f"WITH {PRED}, {RES}, {NEXT} SELECT symbol, target_time, step, (close - coalesce(before, base_price)) / (coalesce(before, base_price) + 1e-8) AS r FROM nx WHERE m = 6 UNION ALL SELECT symbol, target_time, unnest(range(1, 7)), (actual_price - base_price) / (base_price + 1e-8) / 6 FROM nx WHERE m < 6 AND step = 1",
    "r",
    "target_time",
    "step",
)
def ev6_realized_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = E.realized_returns(resolved(spark, sf_dir).where("actual_price is not null"))
    return r.select("symbol", "target_time", F.posexplode("returns").alias("step", "r")).withColumn("step", F.col("step") + 1)


@query(
    f"""WITH RECURSIVE {PRED}, {RES}, {NEXT}, er AS (SELECT symbol, target_time, step, base_price + (predicted_price - base_price) * .167 + (predicted_price - base_price) * .833 * (step - 1) / 5 - close AS e, row_number() OVER (PARTITION BY symbol, step ORDER BY target_time) AS n FROM nx WHERE m = 6),
    b AS (SELECT symbol, target_time, step, n, .25 * e AS x FROM er WHERE n = 1 UNION ALL SELECT e.symbol, e.target_time, e.step, e.n, .75 * b.x + .25 * e.e FROM b JOIN er e ON e.symbol = b.symbol AND e.step = b.step AND e.n = b.n + 1)
    SELECT symbol, target_time, step, CAST(round(CAST(x AS DECIMAL(18, 9)), 4) AS DOUBLE) AS bias FROM b""",
    "bias",
    "target_time",
    "step",
)
def ev7_step_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.step_bias(scored(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {BARS}, o AS (SELECT symbol, bar_ts, close AS p, open + 2 AS hi, open - 2 AS lo, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS n FROM bars),
    s AS (SELECT DISTINCT symbol, CAST(NULL AS TIMESTAMP) AS bar_ts, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS high_bias, CAST(0 AS DOUBLE) AS low_bias FROM o UNION ALL
      SELECT o.symbol, o.bar_ts, o.n, CASE WHEN p > hi THEN .3 * (p - hi) + .7 * high_bias WHEN p < hi - 3 THEN .7 * (p - hi) * .1 + .3 * high_bias ELSE high_bias END,
      CASE WHEN p < lo THEN .3 * (p - lo) + .7 * low_bias WHEN p > lo + 3 THEN .7 * (p - lo) * .1 + .3 * low_bias ELSE low_bias END FROM s JOIN o ON o.symbol = s.symbol AND o.n = s.n + 1)
    SELECT symbol, bar_ts, high_bias, low_bias FROM s WHERE n > 0""",
    "high_bias low_bias",
    "bar_ts",
)
def ev8_extrema_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bars(spark, sf_dir).select("symbol", "bar_ts", F.col("close").alias("price"), (F.col("open") + 2).alias("pred_high"), (F.col("open") - 2).alias("pred_low"))
    return E.extrema_bias(d).select("symbol", "bar_ts", "high_bias", "low_bias")


def known_samples(spark: SparkSession, sf_dir: str, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every prediction of every bar with its scores and the times from which they are known; and its features with the
    returns that came, known from ``ts`` on."""
    p = predictions(spark, sf_dir).withColumn("actual_price", F.lit(None).cast("double"))
    done = settled(E.score_predictions(E.resolve_actuals(p, placed, times=True)), "scored")
    made = X.feature_vector(X.bar_features(placed.select("symbol", "bar_ts", *OHLCV)))
    r = E.realized_returns(done).select("symbol", F.col("created_at").alias("bar_ts"), "returns", F.col("closes_ts").alias("ts"))
    return done, made.join(r, ["symbol", "bar_ts"]).select("symbol", "ts", "features", "returns")


def feedback(spark: SparkSession, sf_dir: str, queries: DataFrame, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was known at each query's last bar: (symbol, q_trading_date, win_rate, k, mse, biases, inst_factor), and the
    model's returns for its ``inputs`` (symbol, q_trading_date, features, imbalance)."""
    b = bars(spark, sf_dir)
    b = settled(with_position(b), "bars")
    done, samples = known_samples(spark, sf_dir, b)
    day = F.col("q_trading_date").cast("string").alias("key")
    asked = queries.join(inputs.select("symbol", "q_trading_date", "features"), ["symbol", "q_trading_date"], "left")
    said = L.replay(samples, asked.select("symbol", day, F.col("as_of").alias("ts"), "features"))
    said = settled(said.withColumn("q_trading_date", F.col("key").cast("date")), "said")
    flow = inputs.select("symbol", "q_trading_date", X.institution_factor(F.lit(0.0), F.col("imbalance")).alias("inst_factor"))
    known = V.as_of(done, queries.select("symbol", "q_trading_date", "as_of")).join(said.select("symbol", "q_trading_date", "mse"), ["symbol", "q_trading_date"], "left")
    return settled(known.join(flow, ["symbol", "q_trading_date"], "left"), "feedback"), said


@query(f"WITH {BARS} SELECT symbol, avg(abs((close - open) / (close + 1e-8))) AS mape, last(close - open ORDER BY bar_ts) AS last_error, avg(close - open) AS mean_error, avg(abs((close - open) / (close + 1e-8))) > .005 AS rematch FROM bars GROUP BY 1", "mape last_error mean_error")
def ev9_mape_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.mape_check(bars(spark, sf_dir).select("symbol", "bar_ts", F.col("close").alias("actual"), F.col("open").alias("predicted")))


@query(
    f"""WITH {ALL} SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY target_time DESC) AS k, '[' || strftime(target_time, '%H:%M') || '] ' || CASE is_direction_correct WHEN 1 THEN 'hit' ELSE 'miss' END || ' ' || CASE predicted_direction WHEN 'UP' THEN '^' WHEN 'DOWN' THEN 'v' ELSE '-' END
    || ' (' || advice_type || ' ' || CASE is_advice_correct WHEN 1 THEN 'ok' ELSE 'no' END || ')' AS line, predicted_price, actual_price FROM scored QUALIFY k <= 10""",
    "predicted_price actual_price",
    "",
    "k",
)
def ev10_review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.review_log(scored(spark, sf_dir))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each bar with the returns of the next six."""
    d = settled(X.feature_vector(X.bar_features(bars(spark, sf_dir))), "features")
    r = E.realized_returns(resolved(spark, sf_dir).where("actual_price is not null"))
    return d.join(r.select("symbol", F.col("created_at").alias("bar_ts"), "returns"), ["symbol", "bar_ts"]).withColumnRenamed("bar_ts", "ts")


@query()
def ml1_model_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    state = L.fit_online(s)
    d = s.select("symbol", "ts", "features", F.lit(100.0).alias("last_price"))
    p = L.model_predict(d, settled(state, "model"))
    return p.select("symbol", "ts", F.element_at("path", -1).alias("end"))


@query()
def ml2_fit_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = L.fit_online(samples(spark, sf_dir))
    return m.select("symbol", "train_count", "ema_mse", "last_mse", F.size("weights").alias("n_weights"))


@query(
    f"""WITH {BARS}, s AS (SELECT symbol, bar_ts, CAST(volume AS INT) % 9 AS train_count, (close % 13) * 1e-5 AS ema_mse FROM bars) SELECT symbol, bar_ts, train_count, CAST(CASE WHEN train_count >= 5 AND ema_mse > 0 THEN round_even(10 + 40 * greatest(0, least(1, 1 - ema_mse / 1e-4)), 0) ELSE 10 END AS BIGINT) AS ensemble_weight FROM s""",
    "",
    "bar_ts",
    "train_count",
)
def ml3_model_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bars(spark, sf_dir).select(F.concat_ws("|", "symbol", F.date_format("bar_ts", "yyyy-MM-dd HH:mm:ss")).alias("symbol"), (F.col("volume").cast("int") % 9).alias("train_count"), (F.col("close") % 13 * 1e-5).alias("ema_mse"), F.lit(0.0).alias("last_mse"))
    m = L.model_status(d)
    return m.select(F.split("symbol", "\\|")[0].alias("symbol"), F.split("symbol", "\\|")[1].alias("bar_ts"), "train_count", "ensemble_weight")


@query(
    f"""WITH {BARS}, r AS (SELECT symbol, open AS l, (high + low) / 2 - open AS said, close - open AS came, abs(close - open) AS mape FROM bars), t AS (SELECT *, abs(said) > .05 AS s, sign(said) * came / l AS x FROM r)
    SELECT symbol, count(*) AS n, avg(mape) AS mape, count(*) FILTER (s) AS signals, 100.0 * count(*) FILTER (s AND sign(said) = sign(came)) / count(*) FILTER (s) AS win_rate, avg(x) FILTER (s) AS mean_return,
    avg(x) FILTER (s) / (stddev_pop(x) FILTER (s) + 1e-8) * sqrt(252 * 1440) AS sharpe FROM t GROUP BY 1""",
    "mape win_rate mean_return sharpe",
    "",
    "n signals",
)
def bt2_backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bars(spark, sf_dir).select("symbol", F.col("open").alias("last_price"), ((F.col("high") + F.col("low")) / 2).alias("predicted_end"), F.col("close").alias("actual_end"), F.abs(F.col("close") - F.col("open")).alias("mape"))
    return B.backtest_metrics(d)
