"""Queries that run the streaming jobs to the end of the data that is there and read what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.functions.scratch import shared_path
from barweave.jobs.forecast_queries import ADVICE_IN, advice_inputs
from barweave.operators import forecast as P
from barweave.jobs.learn_queries import NEXT, PRED, RES, SCORED, predictions, scored
from barweave.registry import query
from barweave.sources.events import BARS, TICKS, bars, bars_cte, ticks
from barweave.streaming import bars as S
from barweave.streaming import state as K

OHLCV = "open high low close volume"


def as_stream(df: DataFrame) -> DataFrame:
    """A table as a stream of its files."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "stream-in")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def finished(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    out = shared_path(spark, "stream-out")
    S.run_to_table(stream, out, shared_path(spark, "stream-cp")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(f"WITH {BARS} SELECT symbol, bar_ts, close FROM bars", "close", "bar_ts")
def st1_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar comes twice; the table has it once."""
    b = bars(spark, sf_dir).select("symbol", "bar_ts", "close")
    out = shared_path(spark, "ingested")
    source = as_stream(b.unionByName(b))
    S.stream_ingest(source, out, shared_path(spark, "ingest-cp")).awaitTermination()
    return spark.read.schema(b.schema).parquet(out).select("symbol", "bar_ts", "close")


@query(f"WITH {TICKS}, {bars_cte('all_bars')}, m AS (SELECT max(ts) AS t FROM ticks) SELECT a.* FROM all_bars a, m WHERE bar_ts + INTERVAL 1 HOUR <= t - INTERVAL 30 MINUTE", OHLCV, "bar_ts")
def st2_stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that the watermark has closed by the end of the stream; one open hour stays in state."""
    return finished(S.stream_bars(as_stream(ticks(spark, sf_dir)), "1 hour", "30 minutes"))


@query(f"WITH {TICKS} SELECT symbol, event_id, ts FROM ticks", "", "ts")
def st3_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).select("symbol", "event_id", "ts")
    return finished(S.stream_dedupe(as_stream(t.unionByName(t)), ["symbol", "event_id"]))


LATE = """late AS (SELECT max(bar_ts) - INTERVAL 10 MINUTE AS seen FROM bars),
fb AS (SELECT d.*, b.bar_ts AS actual_ts, b.close AS actual_price FROM pred d ASOF LEFT JOIN bars b ON d.symbol = b.symbol AND b.bar_ts >= d.target_time),
fw AS (SELECT * REPLACE (CASE WHEN actual_ts <= target_time + INTERVAL 2 HOUR THEN actual_ts END AS actual_ts, CASE WHEN actual_ts <= target_time + INTERVAL 2 HOUR THEN actual_price END AS actual_price) FROM fb),
res AS (SELECT fw.* FROM fw, late WHERE coalesce(actual_ts, target_time + INTERVAL 2 HOUR) < seen)"""


@query(
    f"""WITH {PRED}, {LATE}, {SCORED} SELECT symbol, target_time, actual_ts, actual_price, CASE WHEN actual_price IS NOT NULL THEN coalesce(is_direction_correct, 0) ELSE -1 END AS is_direction_correct,
    CASE WHEN actual_price IS NOT NULL THEN coalesce(is_range_correct, 0) ELSE -1 END AS is_range_correct, CASE WHEN actual_price IS NOT NULL THEN coalesce(is_advice_correct, 0) ELSE -1 END AS is_advice_correct FROM scored""",
    "actual_price",
    "target_time actual_ts",
    "is_direction_correct is_range_correct is_advice_correct",
)
def st4_stream_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight from the stream: each prediction once, scored by its first bar or closed without one (flags -1)."""
    p = predictions(spark, sf_dir)
    found = finished(K.stream_evaluate(as_stream(p), as_stream(bars(spark, sf_dir).select("symbol", "bar_ts", "close"))))
    flags = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("is_direction_correct", "is_range_correct", "is_advice_correct")]
    return found.select("symbol", "target_time", "actual_ts", "actual_price", *flags)


@query(
    f"""WITH RECURSIVE {ADVICE_IN}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS n FROM a6),
    s AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS n, CAST(NULL AS TIMESTAMP) AS ts, 'WAIT' AS advice FROM o UNION ALL
      SELECT o.symbol, o.n, o.bar_ts, CASE WHEN (s.advice = 'STRONG_BUY' AND x.b = 'STRONG_SELL') OR (s.advice = 'STRONG_SELL' AND x.b = 'STRONG_BUY') THEN 'WAIT' ELSE x.b END
      FROM s JOIN o ON o.symbol = s.symbol AND o.n = s.n + 1, LATERAL (SELECT CASE WHEN s.advice IN ('STRONG_BUY', 'BUY_DIP') AND o.up >= 2.5 AND o.pos <= .85 AND o.peak > 15 AND o.a IN ('SELL_RISK', 'STRONG_SELL') THEN 'BUY_DIP' ELSE o.a END AS b) x)
    SELECT symbol, ts, advice FROM s WHERE n > 0""",
    "",
    "ts",
)
def st5_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = P.raw_advice(advice_inputs(spark, sf_dir)).select("symbol", F.col("q_trading_date").alias("ts"), "advice_raw", "upside", "position", "high_step")
    return finished(K.stream_state(as_stream(K.events(raw, "advice")))).select("symbol", "ts", "advice")


@query(
    f"""WITH RECURSIVE {PRED}, {RES}, {NEXT}, er AS (SELECT symbol, target_time, step, base_price + (predicted_price - base_price) * .167 + (predicted_price - base_price) * .833 * (step - 1) / 5 - close AS e, row_number() OVER (PARTITION BY symbol, step ORDER BY target_time) AS n FROM nx WHERE m = 6),
    b AS (SELECT symbol, target_time, step, n, .25 * e AS x FROM er WHERE n = 1 UNION ALL SELECT e.symbol, e.target_time, e.step, e.n, .75 * b.x + .25 * e.e FROM b JOIN er e ON e.symbol = b.symbol AND e.step = b.step AND e.n = b.n + 1)
    SELECT symbol, target_time AS ts, step, x AS bias FROM b""",
    "bias",
    "ts",
    "step",
)
def st5_stream_biases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step biases of each series, kept in the stream's state."""
    rows = K.events(scored(spark, sf_dir), "steps", "target_time").where(F.size("closes") == 6)
    found = finished(K.stream_state(as_stream(rows)))
    return found.select("symbol", "ts", F.posexplode("steps").alias("step", "bias")).withColumn("step", F.col("step") + 1)
