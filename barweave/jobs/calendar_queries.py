"""Queries of the calendar operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.operators import calendar as K
from barweave.registry import query
from barweave.sources.events import BARS, bars

DAY = "CAST(bar_ts - INTERVAL 6 HOUR AS DATE)"


@query(f"WITH {BARS} SELECT symbol, bar_ts, strftime({DAY}, '%Y-%m-%d') AS trading_date FROM bars", "", "bar_ts")
def tm1_trading_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("symbol", "bar_ts", K.trading_date("bar_ts").alias("trading_date"))


@query(
    f"""WITH {BARS}, d AS (SELECT symbol, bar_ts, {DAY} AS day FROM bars) SELECT symbol, bar_ts, strftime(day, '%Y-%m-%d') AS trading_date,
    row_number() OVER (PARTITION BY symbol, day ORDER BY bar_ts) AS session_pos, count(*) OVER (PARTITION BY symbol, day) AS day_bars, day = max(day) OVER (PARTITION BY symbol) AS is_last_day FROM d""",
    "",
    "bar_ts",
    "session_pos day_bars",
)
def tm2_session_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.session_position(bars(spark, sf_dir)).select("symbol", "bar_ts", "trading_date", "session_pos", "day_bars", "is_last_day")


@query(
    f"""WITH {BARS}, r AS (SELECT symbol, close, bar_ts, {DAY} AS day, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) AS k FROM bars),
    n AS (SELECT symbol, greatest(20, count(*) FILTER (day = last_day)) AS n FROM (SELECT *, max(day) OVER (PARTITION BY symbol) AS last_day FROM r) GROUP BY 1)
    SELECT symbol, n, n - k AS i, close FROM r JOIN n USING (symbol) WHERE k <= n""",
    "close",
    "",
    "n i",
)
def tm3_current_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = K.current_query(bars(spark, sf_dir), min_points=20)
    return q.select("symbol", "n", F.posexplode("closes").alias("i", "close"))


@query(
    f"""WITH {BARS}, asked AS (SELECT row_number() OVER (ORDER BY symbol, bar_ts) AS request, symbol, bar_ts - INTERVAL 5 HOUR AS a, bar_ts + INTERVAL 20 HOUR AS b FROM bars WHERE hour(bar_ts) = 10)
    SELECT a.symbol || '/' || strftime(a.a, '%Y-%m-%d %H') AS request, b.bar_ts, b.close FROM asked a JOIN bars b ON b.symbol = a.symbol AND b.bar_ts BETWEEN a.a AND a.b""",
    "close",
    "bar_ts",
)
def tm4_slice_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    start, end = F.col("bar_ts") - F.expr("INTERVAL 5 HOURS"), F.col("bar_ts") + F.expr("INTERVAL 20 HOURS")
    asked = b.where(F.hour("bar_ts") == 10).select(F.concat_ws("/", "symbol", F.date_format(start, "yyyy-MM-dd HH")).alias("request"), "symbol", start.alias("start"), end.alias("end"))
    return K.slice_range(b, asked).select("request", "bar_ts", "close")


@query(f"WITH {BARS} SELECT symbol, bar_ts, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) <= 100", "close", "bar_ts")
def tm5_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tail(bars(spark, sf_dir), 100).select("symbol", "bar_ts", "close")


@query(
    f"""WITH {BARS}, l AS (SELECT symbol, max(bar_ts) AS last, unnest(range(1, 7)) AS step FROM bars GROUP BY 1), t AS (SELECT symbol, step, last + to_hours(step) AS ts FROM l)
    SELECT symbol, step, ts, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso, strftime(ts, '%H:%M') AS label FROM t""",
    "",
    "ts",
    "step",
)
def tm6_future_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.future_axis(bars(spark, sf_dir), 6, "1 hour")


@query(
    f"""WITH {BARS} SELECT symbol, bar_ts, CASE WHEN CAST(bar_ts AS DATE) = CAST(max(bar_ts) OVER (PARTITION BY symbol) AS DATE) THEN strftime(bar_ts, '%H:%M') ELSE strftime(bar_ts, '%m-%d %H:%M') END AS label FROM bars""",
    "",
    "bar_ts",
)
def tm7_axis_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.axis_labels(bars(spark, sf_dir)).select("symbol", "bar_ts", "label")


@query(f"WITH {BARS} SELECT symbol, bar_ts, greatest(6, CAST(floor((epoch(date_trunc('day', bar_ts)) + 86399 - epoch(bar_ts)) / 3600) AS BIGINT)) AS steps_left FROM bars", "", "bar_ts", "steps_left")
def tm8_steps_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("symbol", "bar_ts", K.steps_left(F.col("bar_ts"), 3600).alias("steps_left"))


@query(f"WITH {BARS}, n AS (SELECT symbol FROM bars GROUP BY 1 HAVING count(*) >= 677) SELECT symbol, count(*) AS n FROM bars WHERE symbol IN (SELECT symbol FROM n) GROUP BY 1", "", "", "n")
def tm9_require_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.require_history(bars(spark, sf_dir), 677).groupBy("symbol").count().withColumnRenamed("count", "n")
