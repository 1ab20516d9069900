"""Queries of the reporting operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.jobs.forecast_queries import ALL as FORECASTS
from barweave.jobs.forecast_queries import STEPS, paths_of
from barweave.jobs.learn_queries import PRED, WIN, predictions, rates_of, scored
from barweave.jobs.match_queries import N
from barweave.operators import evaluation as E
from barweave.operators import forecast as P
from barweave.operators import reporting as R
from barweave.registry import query
from barweave.sources.events import BARS, bars


@query(
    f"""WITH {PRED}, t AS (SELECT symbol, bar_ts AS ts, close, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) AS k, max(bar_ts) OVER (PARTITION BY symbol) AS last FROM bars),
    ax AS (SELECT symbol, ts, last, CASE WHEN CAST(ts AS DATE) = CAST(last AS DATE) THEN strftime(ts, '%H:%M') ELSE strftime(ts, '%m-%d %H:%M') END AS label, CAST(round(CAST(close AS DECIMAL(18, 9)), 2) AS DOUBLE) AS real, NULL AS step FROM t WHERE k <= 50
      UNION ALL SELECT symbol, last + to_hours(s), last, strftime(last + to_hours(s), '%H:%M'), NULL, s FROM (SELECT symbol, last, unnest(range(1, 7)) AS s FROM t WHERE k = 1))
    SELECT ax.symbol, ax.ts, label, real, CASE WHEN ax.ts = last THEN real ELSE 50.0 + step END AS predicted, CASE WHEN ax.ts = last THEN real ELSE 51.0 + step END AS upper, CASE WHEN ax.ts = last THEN real ELSE 49.0 + step END AS lower,
    p.predicted_price AS hist_pred, coalesce(p.advice_type, 'WAIT') AS advice_type FROM ax LEFT JOIN pred p ON p.symbol = ax.symbol AND p.target_time = ax.ts""",
    "real predicted upper lower hist_pred",
    "ts",
)
def rp1_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    steps = b.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("step"))
    f = steps.select("symbol", "step", (50.0 + F.col("step")).alias("predicted"), (51.0 + F.col("step")).alias("upper"), (49.0 + F.col("step")).alias("lower"))
    p = predictions(spark, sf_dir).select("symbol", F.col("target_time").alias("ts"), F.col("predicted_price").alias("price"), "advice_type")
    return R.timeline(b, f, p, n=50, steps=6, width="1 hour")


TRACKS = f"""lastq AS (SELECT symbol, max(q_day) AS q_day FROM chosen GROUP BY 1), ends AS (SELECT symbol, max(p) AS top_p, max(bar_ts) AS top_ts FROM pos GROUP BY 1),
axis AS (SELECT symbol, bar_ts AS ts, top_p - p + {STEPS} AS back, 0 AS step, close AS real FROM pos JOIN ends USING (symbol) WHERE p > top_p - 50 UNION ALL SELECT symbol, top_ts + to_hours(s), {STEPS} - s, s, NULL FROM (SELECT *, unnest(range(1, {STEPS + 1})) AS s FROM ends)),
sp AS (SELECT c.symbol, c.q_day, p.p - c.start_pos AS step, p.close, row_number() OVER (PARTITION BY c.symbol ORDER BY p.p DESC) - 1 AS back FROM chosen c JOIN lastq USING (symbol, q_day) JOIN pos p ON p.symbol = c.symbol AND p.p BETWEEN c.start_pos AND c.start_pos + {N - 1 + STEPS} WHERE rank = 1),
h AS (SELECT symbol, q_day, avg(close) AS h FROM sp WHERE step < {N} GROUP BY 1, 2), t AS (SELECT symbol, day AS q_day, list_avg(closes) AS t FROM raw),
tp AS (SELECT symbol, back, CAST(round(CAST(close - h + t AS DECIMAL(18, 9)), 2) AS DOUBLE) AS top1 FROM sp JOIN h USING (symbol, q_day) JOIN t USING (symbol, q_day)),
tr AS (SELECT symbol, rank, step, CAST(round(CAST(price AS DECIMAL(18, 9)), 2) AS DOUBLE) AS price FROM path JOIN lastq USING (symbol, q_day)),
ranks AS (SELECT DISTINCT symbol, rank FROM tr),
pts AS (SELECT a.symbol, a.ts, r.rank, CASE WHEN a.step = 0 THEN CAST(round(CAST(a.real AS DECIMAL(18, 9)), 2) AS DOUBLE) ELSE tr.price END AS price FROM axis a JOIN ranks r USING (symbol) LEFT JOIN tr ON tr.symbol = a.symbol AND tr.rank = r.rank AND tr.step = a.step WHERE a.step > 0 OR a.back = {STEPS})"""


@query(
    f"""WITH {FORECASTS}, {TRACKS} SELECT axis.symbol, axis.ts, top1, {", ".join(f"max(price) FILTER (rank = {k}) AS track{k}" for k in (1, 2, 3))}
    FROM axis LEFT JOIN tp USING (symbol, back) LEFT JOIN pts ON pts.symbol = axis.symbol AND pts.ts = axis.ts GROUP BY 1, 2, 3""",
    "top1 track1 track2 track3",
    "ts",
)
def rp1_timeline_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axis of the grid with the tracks and the aligned best match of each series' last matched day."""
    g, q, m, paths = paths_of(spark, sf_dir)
    last = m.groupBy("symbol").agg(F.max("q_trading_date").alias("q_trading_date"))
    own = lambda d: d.join(last, list(P.KEY), "left_semi")
    top1 = own(P.mean_aligned_track(m, g, q, N, STEPS)).groupBy("symbol").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "price"))), lambda x: x["price"]).alias("top1_track"))
    none = g.select("symbol", F.lit(1).alias("step"), *[F.lit(None).cast("double").alias(c) for c in ("predicted", "upper", "lower")]).limit(0)
    past = g.select("symbol", F.col("bar_ts").alias("ts"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("advice_type")).limit(0)
    d = R.timeline(g.select("symbol", "bar_ts", "close"), none, past, 50, STEPS, "1 hour", top1, own(P.history_tracks(paths)))
    of = lambda k: F.get(F.transform(F.filter("tracks", lambda t: t["rank"] == k), lambda t: t["price"]), F.lit(0)).alias(f"track{k}")
    return d.select("symbol", "ts", "top1", of(1), of(2), of(3))


@query(
    f"""WITH {PRED}, p AS (SELECT symbol, target_time AS ts, last(predicted_price ORDER BY bar_ts) AS price FROM pred GROUP BY 1, 2), a AS (SELECT symbol, ts, last(advice_type ORDER BY bar_ts) AS advice_type FROM (SELECT symbol, bar_ts, bar_ts AS ts, advice_type FROM pred UNION ALL SELECT symbol, bar_ts, target_time, advice_type FROM pred) GROUP BY 1, 2)
    SELECT symbol, ts, price, advice_type FROM p FULL JOIN a USING (symbol, ts)""",
    "price",
    "ts",
)
def rp2_prediction_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.prediction_maps(predictions(spark, sf_dir))


@query(
    f"""WITH {WIN}, f AS (SELECT symbol, last(close ORDER BY bar_ts) AS last_price FROM bars GROUP BY 1), m AS (SELECT symbol, avg(abs((actual_price - predicted_price) / (actual_price + 1e-8))) AS mape FROM scored GROUP BY 1)
    SELECT symbol, CAST(round(CAST(last_price AS DECIMAL(18, 9)), 2) AS DOUBLE) AS last_price, CAST(round(CAST(win_rate AS DECIMAL(18, 9)), 1) AS DOUBLE) AS win_rate, CAST(round(CAST(mape AS DECIMAL(18, 9)), 4) AS DOUBLE) AS mape, n FROM f JOIN win USING (symbol) JOIN m USING (symbol)""",
    "last_price win_rate mape",
    "",
    "n",
)
def rp3_summary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    last = bars(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "bar_ts").alias("last_price"))
    rate = rates_of(spark, sf_dir)
    mape = E.mape_check(s.select("symbol", F.col("target_time").alias("bar_ts"), F.col("actual_price").alias("actual"), F.col("predicted_price").alias("predicted")))
    return R.summary_metrics(last, rate.join(mape.select("symbol", "mape"), "symbol"))


@query(
    f"""WITH {BARS}, d AS (SELECT symbol, bar_ts, open, close - open AS ch FROM bars) SELECT symbol, bar_ts, CAST(round(CAST(ch AS DECIMAL(18, 9)), 2) AS DOUBLE) AS change, CASE WHEN open <> 0 THEN CAST(round(CAST(ch / open * 100 AS DECIMAL(18, 9)), 2) AS DOUBLE) ELSE 0.0 END AS change_pct,
    CASE WHEN ch > .05 THEN 'up' WHEN ch < -.05 THEN 'down' ELSE 'flat' END AS trend FROM d""",
    "change change_pct",
    "bar_ts",
)
def rp4_trend_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bars(spark, sf_dir).select("symbol", "bar_ts", F.col("open").alias("last_price"), F.col("close").alias("target_price"))
    return R.trend_card(d).select("symbol", "bar_ts", "change", "change_pct", "trend")
