"""Adapter: the events table as ticks of several series, and tables derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.operators import cleaning


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, event_id, price, volume, source) from events; columns are pruned in the scan."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.col("value").cast("double").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
        F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("source"),
    )


def bars(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    """(symbol, bar_ts, open, high, low, close, volume) resampled from ticks."""
    return cleaning.resample_ohlcv(ticks(spark, sf_dir), width)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars interpolated to the full grid, so that whole trading days have 24 of them."""
    return cleaning.upsample_interpolate(bars(spark, sf_dir), "1 hour")


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, event_id, rate): the view series as an exchange rate."""
    t = ticks(spark, sf_dir).where("symbol = 'view'")
    return t.select("ts", "event_id", (F.col("price") / 10 + 1).alias("rate"))


# The same tables as DuckDB common table expressions.
TICKS = """ticks AS (SELECT event_type AS symbol, CAST(ts AS TIMESTAMP) AS ts, event_id, CAST(value AS DOUBLE) AS price,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, 'u' || CAST(user_id % 3 AS VARCHAR) AS source FROM events)"""


def bars_cte(name: str = "bars", unit: str = "hour", source: str = "ticks") -> str:
    bucket = f"date_trunc('{unit}', ts)" if unit in ("hour", "day", "minute") else f"time_bucket(INTERVAL '{unit}', ts)"
    return f"""{name} AS (SELECT symbol, {bucket} AS bar_ts, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ts, event_id) AS close, sum(volume) AS volume FROM {source} GROUP BY 1, 2)"""


BARS = f"{TICKS}, {bars_cte()}"


def grid_cte(name: str = "grid", source: str = "bars") -> str:
    mix = ", ".join(f"CASE WHEN g.bar_ts = a.bar_ts THEN a.{c} ELSE a.{c} + (a.n_{c} - a.{c}) * (epoch(g.bar_ts) - epoch(a.bar_ts)) / (epoch(a.nxt) - epoch(a.bar_ts)) END AS {c}" for c in ("open", "high", "low", "close", "volume"))
    leads = ", ".join(f"lead({c}) OVER w AS n_{c}" for c in ("open", "high", "low", "close", "volume"))
    return f"""{name}_a AS (SELECT *, lead(bar_ts) OVER w AS nxt, {leads} FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)),
{name} AS (SELECT g.symbol, g.bar_ts, {mix} FROM (SELECT symbol, bar_ts AS anchor, unnest(generate_series(bar_ts, coalesce(nxt - INTERVAL 1 HOUR, bar_ts), INTERVAL 1 HOUR)) AS bar_ts FROM {name}_a) g
  JOIN {name}_a a ON a.symbol = g.symbol AND a.bar_ts = g.anchor)"""


GRID = f"{BARS}, {grid_cte()}"
