"""Queries of the storage and cleaning operators over tables derived from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.functions.scratch import shared_path
from barweave.operators import cleaning as C
from barweave.operators import storage as S
from barweave.registry import query
from barweave.sources.events import BARS, GRID, TICKS, bars, bars_cte, grid, rates, ticks

OHLCV = "open high low close volume"
#: The day in the middle of the bars, in SQL.
MID = "(SELECT date_trunc('day', make_timestamp((epoch_us(min(bar_ts)) + epoch_us(max(bar_ts))) // 2)) FROM bars)"


def middle(b: DataFrame) -> Column:
    """The day in the middle of the bars."""
    ends = b.agg(F.unix_micros(F.min("bar_ts")), F.unix_micros(F.max("bar_ts"))).first()
    return F.date_trunc("day", F.timestamp_micros(F.lit(((ends[0] or 0) + (ends[1] or 0)) // 2)))



def source_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars tagged with the source of their first tick."""
    t = ticks(spark, sf_dir)
    tag = t.groupBy("symbol", F.window("ts", "1 hour").alias("w")).agg(F.min_by("source", F.struct("ts", "event_id")).alias("source"))
    return bars(spark, sf_dir).join(tag.select("symbol", F.col("w.start").alias("bar_ts"), "source"), ["symbol", "bar_ts"])


SOURCE_BARS = f"""{BARS}, sbars AS (SELECT b.*, s.source FROM bars b JOIN (SELECT symbol, date_trunc('hour', ts) AS bar_ts,
  first(source ORDER BY ts, event_id) AS source FROM ticks GROUP BY 1, 2) s USING (symbol, bar_ts))"""


@query(f"WITH {SOURCE_BARS} SELECT symbol, bar_ts, close, source FROM sbars WHERE source = 'u1' OR symbol NOT IN (SELECT symbol FROM sbars WHERE source = 'u1')", "close", "bar_ts")
def io1_read_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "bars")
    source_bars(spark, sf_dir).write.parquet(path)
    return S.read_bars(spark, path, "u1").select("symbol", "bar_ts", "close", "source")


@query(f"WITH {SOURCE_BARS} SELECT symbol, bar_ts, close, source FROM sbars WHERE source = 'u2'", "close", "bar_ts")
def io2_purge_other_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.purge_other_sources(source_bars(spark, sf_dir), "u2").select("symbol", "bar_ts", "close", "source")


@query(
    f"""WITH {BARS}, old AS (SELECT * FROM bars WHERE bar_ts < {MID}), batch AS (SELECT symbol, bar_ts, open, high, low, close + 1 AS close,
    CASE WHEN hour(bar_ts) % 2 = 0 THEN volume END AS volume FROM bars WHERE bar_ts >= {MID} - INTERVAL 3 DAY)
    SELECT * FROM old UNION ALL SELECT * REPLACE (coalesce(volume, 0) AS volume) FROM batch b WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.symbol = b.symbol AND o.bar_ts = b.bar_ts)""",
    OHLCV,
    "bar_ts",
)
def io3_append_new_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    old = b.where(F.col("bar_ts") < middle(b))
    batch = b.where(F.col("bar_ts") >= middle(b) - F.expr("INTERVAL 3 DAYS"))
    batch = batch.withColumns({"close": F.col("close") + 1, "volume": F.when(F.hour("bar_ts") % 2 == 0, F.col("volume"))})
    return S.append_new_bars(old, batch)


@query(
    f"WITH {BARS} SELECT symbol, bar_ts, CASE WHEN bar_ts >= {MID} - INTERVAL 3 DAY THEN close + 1 ELSE close END AS close, CASE WHEN bar_ts >= {MID} - INTERVAL 3 DAY THEN 2 ELSE 1 END AS version FROM bars",
    "close",
    "bar_ts",
    "version",
)
def io4_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).select("symbol", "bar_ts", "close")
    batch = b.where(F.col("bar_ts") >= middle(b) - F.expr("INTERVAL 3 DAYS"))
    return S.upsert_latest(b.withColumn("version", F.lit(1)), batch.select("symbol", "bar_ts", (F.col("close") + 1).alias("close"), F.lit(2).alias("version")), ["symbol", "bar_ts"], "version")


@query(f"WITH {BARS} SELECT symbol, strftime(bar_ts, '%Y-%m') AS month, count(*) AS n, sum(close) AS close FROM bars GROUP BY 1, 2", "close", "", "n")
def io5_full_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "reload")
    b = bars(spark, sf_dir)
    S.full_reload(b.where("symbol = 'view'"), path)
    S.full_reload(b, path)  # what was there is gone
    read = spark.read.schema("symbol string, bar_ts timestamp, open double, high double, low double, close double, volume double, month string").parquet(path)
    return read.groupBy("symbol", "month").agg(F.count("*").alias("n"), F.sum("close").alias("close"))


@query(f"WITH {BARS} SELECT * FROM bars", OHLCV, "bar_ts")
def io6_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "snapshot")
    S.write_snapshot(bars(spark, sf_dir), path)
    return S.read_snapshot(spark, path)


@query(
    f"""WITH {BARS}, m AS (SELECT *, median(close) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS med FROM bars),
    s AS (SELECT symbol, bar_ts, abs(close - med) > 15 AS hit, med, open, high, low, close, volume FROM m)
    SELECT symbol, bar_ts, CASE WHEN hit THEN CAST(round(CAST(med AS DECIMAL(18, 9)), 2) AS DOUBLE) ELSE open END AS open, CASE WHEN hit THEN CAST(round(CAST(med AS DECIMAL(18, 9)), 2) AS DOUBLE) ELSE high END AS high,
    CASE WHEN hit THEN CAST(round(CAST(med AS DECIMAL(18, 9)), 2) AS DOUBLE) ELSE low END AS low, CASE WHEN hit THEN CAST(round(CAST(med AS DECIMAL(18, 9)), 2) AS DOUBLE) ELSE close END AS close, volume,
    (epoch(bar_ts) - epoch(lag(bar_ts) OVER w)) / 60 AS time_diff, coalesce((epoch(bar_ts) - epoch(lag(bar_ts) OVER w)) / 60 > 60, FALSE) AS is_gap
    FROM s WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)""",
    OHLCV + " time_diff",
    "bar_ts",
)
def io7_incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half cleaned and stored by months, then brought up to date; the SQL is a full rebuild."""
    t = ticks(spark, sf_dir)
    path = shared_path(spark, "clean")
    C.write_months(C.clean_series(t.where(F.col("ts") < middle(bars(spark, sf_dir)) + F.expr("INTERVAL 617 MINUTES")), "1 hour", gap=60.0), path)
    C.refresh_months(spark, path, t, "1 hour", gap=60.0)
    return spark.read.parquet(path).drop("month")


@query(f"WITH {BARS} SELECT symbol, bar_ts, close, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS DOUBLE) AS close_smooth FROM bars", "close close_smooth", "bar_ts")
def io8_align_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("source", T.StringType()), T.StructField("close_smooth", T.DoubleType())])
    return S.align_schema(bars(spark, sf_dir).select("symbol", "bar_ts", "close"), want)


def state_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, key, value): weights named w1_0 to w1_49, each from the first tick of a series that has its number."""
    t = ticks(spark, sf_dir)
    i = (F.col("event_id") % 50).cast("string")
    return t.select("symbol", F.concat(F.lit("w1_"), i).alias("key"), F.round("price", 4).cast("string").alias("value"), "event_id").groupBy("symbol", "key").agg(F.min_by("value", "event_id").alias("value"))


KV = f"""{TICKS}, kv AS (SELECT symbol, 'w1_' || CAST(event_id % 50 AS VARCHAR) AS key, first(round(price, 4) ORDER BY event_id) AS v FROM ticks GROUP BY 1, 2)"""


@query(
    f"""WITH {BARS}, d AS (SELECT symbol, CAST(bar_ts AS DATE) AS day, list(close ORDER BY bar_ts) AS closes FROM bars GROUP BY 1, 2)
    SELECT symbol, day, unnest(range(len(closes))) AS i, unnest(closes) AS v, CAST(NULL AS DOUBLE) AS scalar FROM d
    UNION ALL SELECT symbol, day, -1, NULL, CAST(len(closes) AS DOUBLE) FROM d""",
    "v scalar",
    "",
    "i",
)
def io9_state_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("day", F.to_date("bar_ts"))
    d = b.groupBy("symbol", "day").agg(F.transform(F.sort_array(F.collect_list(F.struct("bar_ts", "close"))), lambda x: x["close"]).alias("value"))
    both = S.state_to_json(d, ["value"]).unionByName(d.select("symbol", "day", F.size("value").cast("string").alias("value")))
    back = S.state_from_json(both, "value")
    return back.select("symbol", "day", F.explode(F.coalesce(F.transform("vector", lambda x, i: F.struct(i.alias("i"), x.alias("v"))), F.array(F.struct(F.lit(-1).alias("i"), F.lit(None).cast("double").alias("v"))))).alias("x"), "scalar").select("symbol", "day", "x.i", "x.v", "scalar")


@query(
    f"WITH {KV}, c AS (SELECT symbol, CAST(split_part(key, '_', 2) AS INT) AS i, v FROM kv) SELECT symbol, i // 6 AS \"row\", count(*) AS n, sum(v) AS total, first(v ORDER BY i) AS first_v FROM c WHERE i < 48 GROUP BY 1, 2",
    "total first_v",
    "",
    "row n",
)
def io10_kv_to_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.kv_to_matrix(state_kv(spark, sf_dir), "w1", 6, 8)
    return m.select("symbol", "row", F.size("values").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"), F.col("values")[0].alias("first_v"))


@query(f"WITH {KV} SELECT symbol, key FROM kv WHERE NOT (key LIKE 'w1\\_1%' ESCAPE '\\' AND key <> 'w1_12')")
def io11_drop_state_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drop_state_keys(state_kv(spark, sf_dir), r"w1\_1%", "w1_12").select("symbol", "key")


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quote text of each kind for every tick; some are broken."""
    t = ticks(spark, sf_dir)
    p, broken = F.round("price", 2).cast("string"), F.col("event_id") % 7 == 0
    rate = F.concat(F.lit('var hq="t,'), F.when(broken, F.lit("0.0")).otherwise(p), F.lit(",x,"), p, F.lit('"'))
    metal = F.concat(F.lit('var hq="'), p, F.when(broken, F.lit(",1")).otherwise(F.lit(",1,2,3,4,5,6,7,8,9,10,11,12")), F.lit('"'))
    tilde = F.concat(F.lit("v~a~b~"), F.when(broken, F.lit("n/a")).otherwise(p), F.lit("~c"))
    json = F.when(broken, F.lit("{bad")).otherwise(F.concat(F.lit('{"data":{"f43":'), (F.round("price", 2) * 100).cast("int").cast("string"), F.lit("}}")))
    return t.select("symbol", "ts", "event_id", "price", rate.alias("rate"), metal.alias("metal"), tilde.alias("tilde"), json.alias("json"))


@query(
    f"""WITH {TICKS}, q AS (SELECT symbol, event_id, round(price, 2) AS p, event_id % 7 = 0 AS broken FROM ticks)
    SELECT symbol, event_id, p AS rate, CASE WHEN NOT broken THEN p END AS metal, CASE WHEN NOT broken THEN p END AS tilde,
    CASE WHEN NOT broken THEN trunc(p * 100) / 10000 END AS json FROM q""",
    "rate metal tilde json",
)
def cl1_parse_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = raw_quotes(spark, sf_dir)
    for kind in ("rate", "metal", "tilde", "json"):
        q = C.parse_quotes(q, kind, kind).withColumn(kind, F.col("price")).drop("price")
    return q.select("symbol", "event_id", "rate", "metal", "tilde", "json")


@query(
    f"""WITH {TICKS}, q AS (SELECT symbol, ts, event_id, source, CASE WHEN event_id % 3 = 0 THEN -1 ELSE price END AS rate FROM ticks), h AS (SELECT DISTINCT symbol, date_trunc('day', ts) AS day FROM ticks),
    u AS (SELECT h.symbol, h.day, q.rate, CASE source WHEN 'u2' THEN 1 WHEN 'u0' THEN 2 END AS p, epoch(h.day + INTERVAL 1 DAY) - epoch(q.ts) AS age FROM h JOIN q ON q.symbol = h.symbol AND date_trunc('day', q.ts) = h.day
      WHERE q.rate > 0 AND q.source IN ('u2', 'u0') AND epoch(h.day + INTERVAL 1 DAY) - epoch(q.ts) BETWEEN 0 AND 7200)
    SELECT h.symbol, h.day, coalesce((SELECT first(rate ORDER BY p, floor(age)) FROM u WHERE u.symbol = h.symbol AND u.day = h.day), 6.7639) AS rate FROM h""",
    "rate",
    "day",
)
def cl2_pick_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts")).withColumn("rate", F.when(F.col("event_id") % 3 == 0, F.lit(-1.0)).otherwise(F.col("price")))
    return C.pick_rate(t, ["u2", "u0"], F.col("day") + F.expr("INTERVAL 1 DAY"), ttl_s=7200, by=("symbol", "day"))


@query(f"WITH {TICKS} SELECT symbol, date_trunc('minute', ts) AS bar_ts, price AS open, price AS high, price AS low, price AS close, 1.0 AS volume FROM ticks WHERE price > 0 AND event_id % 5 <> 0", OHLCV, "bar_ts")
def cl3_quote_to_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.quote_to_bar(ticks(spark, sf_dir).withColumn("price", F.when(F.col("event_id") % 5 == 0, -F.col("price")).otherwise(F.col("price"))))


@query(f"WITH {BARS} SELECT symbol, bar_ts, open * 7.1 / 31.1034768 AS open, high * 7.1 / 31.1034768 AS high, low * 7.1 / 31.1034768 AS low, close * 7.1 / 31.1034768 AS close, volume FROM bars", OHLCV, "bar_ts")
def cl4_convert_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.convert_units(bars(spark, sf_dir), F.lit(7.1))


@query(f"WITH {BARS} SELECT bar_ts, max(close) FILTER (symbol = 'view') AS \"view\", max(close) FILTER (symbol = 'click') AS click FROM bars GROUP BY 1", "view click", "bar_ts")
def cl5_pivot_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pivot_tickers(bars(spark, sf_dir), ["view", "click"])


WIDE = f"""{BARS}, wide AS (SELECT 'x' AS symbol, bar_ts AS ts, max(close) FILTER (symbol = 'view') AS a, max(close) FILTER (symbol = 'click') AS b FROM bars GROUP BY 2)"""


@query(
    f"WITH {WIDE}, f AS (SELECT ts, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b FROM wide WINDOW w AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT ts, a, b FROM f WHERE a IS NOT NULL",
    "a b",
    "ts",
)
def cl6_fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = C.pivot_tickers(bars(spark, sf_dir), ["view", "click"]).select(F.lit("x").alias("symbol"), F.col("bar_ts").alias("ts"), F.col("view").alias("a"), F.col("click").alias("b"))
    return C.fill_forward(wide, ["a", "b"]).dropna(subset=["a"]).select("ts", "a", "b")


@query(f"WITH {WIDE} SELECT ts, first_value(a IGNORE NULLS) OVER w AS a, first_value(b IGNORE NULLS) OVER w AS b FROM wide WINDOW w AS (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", "a b", "ts")
def cl6_fill_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = C.pivot_tickers(bars(spark, sf_dir), ["view", "click"]).select(F.lit("x").alias("symbol"), F.col("bar_ts").alias("ts"), F.col("view").alias("a"), F.col("click").alias("b"))
    return C.fill_backward(wide, ["a", "b"]).select("ts", "a", "b")


RATES = f"{BARS}, rates AS (SELECT ts, max(price / 10 + 1) AS rate FROM ticks WHERE symbol = 'view' GROUP BY 1)"


@query(f"WITH {RATES} SELECT b.symbol, b.bar_ts, b.close, r.rate, r.ts AS right_ts FROM bars b ASOF LEFT JOIN rates r ON b.bar_ts >= r.ts", "close rate", "bar_ts right_ts")
def cl7_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).select("symbol", "bar_ts", "close")
    left = b.withColumn("ts", F.col("bar_ts"))
    shared = rates(spark, sf_dir).select("ts", "rate")
    return C.asof_join(left, shared, ["rate"], by=(), unit="day").select("symbol", "bar_ts", "close", "rate", "right_ts")


@query(f"WITH {BARS} SELECT symbol, bar_ts, bar_ts + INTERVAL 8 HOUR AS local_ts, strftime(bar_ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local_iso FROM bars", "", "bar_ts local_ts")
def cl8_to_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.to_local(bars(spark, sf_dir).select("symbol", "bar_ts"), "bar_ts")


@query(
    f"""WITH {BARS}, {bars_cte("days", "day")}, u AS (SELECT *, 0 AS p FROM bars WHERE hour(bar_ts) % 3 = 0 UNION ALL SELECT *, 1 FROM days UNION ALL SELECT *, 2 FROM bars)
    SELECT * EXCLUDE (p) FROM u QUALIFY row_number() OVER (PARTITION BY symbol, bar_ts ORDER BY p) = 1""",
    OHLCV,
    "bar_ts",
)
def cl9_merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return C.merge_sources([b.where(F.hour("bar_ts") % 3 == 0), C.resample_ohlcv(ticks(spark, sf_dir), "1 day"), b])


@query(f"WITH {TICKS}, m AS (SELECT symbol, date_trunc('minute', ts) AS ts, event_id, price, volume, source FROM ticks) SELECT symbol, ts, event_id, price FROM m QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY event_id) = 1", "price", "ts")
def cl10_dedupe_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedupe_bars(ticks(spark, sf_dir).withColumn("ts", F.date_trunc("minute", "ts"))).select("symbol", "ts", "event_id", "price")


@query(f"WITH {TICKS} SELECT event_id, date_trunc('second', ts) AS seen_at FROM ticks WHERE event_id % 4 <> 0", "", "seen_at")
def cl11_coerce_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 4 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return C.coerce_time(ticks(spark, sf_dir).select("event_id", text.alias("seen_at")), "seen_at")


@query(f"WITH {TICKS}, {bars_cte('bars', '5 minutes')} SELECT * FROM bars", OHLCV, "bar_ts")
def cl12_resample_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir, "5 minutes")


@query(f"WITH {GRID} SELECT * FROM grid", OHLCV, "bar_ts")
def cl13_upsample_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir)


@query(
    f"""WITH {BARS}, m AS (SELECT *, median(close) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS med FROM bars)
    SELECT symbol, bar_ts, abs(close - med) > 15 AS is_spike, CASE WHEN abs(close - med) > 15 THEN CAST(round(CAST(med AS DECIMAL(18, 9)), 2) AS DOUBLE) ELSE open END AS open,
    CASE WHEN abs(close - med) > 15 THEN CAST(round(CAST(med AS DECIMAL(18, 9)), 2) AS DOUBLE) ELSE close END AS close FROM m""",
    "open close",
    "bar_ts",
)
def cl14_filter_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.filter_spikes(bars(spark, sf_dir)).select("symbol", "bar_ts", "is_spike", "open", "close")


@query(
    f"""WITH {BARS} SELECT symbol, bar_ts, (epoch(bar_ts) - epoch(lag(bar_ts) OVER w)) / 60 AS time_diff,
    coalesce((epoch(bar_ts) - epoch(lag(bar_ts) OVER w)) / 60 > 60, FALSE) AS is_gap FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)""",
    "time_diff",
    "bar_ts",
)
def cl15_flag_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.flag_gaps(bars(spark, sf_dir), 60).select("symbol", "bar_ts", "time_diff", "is_gap")


@query(
    f"""WITH {BARS}, last AS (SELECT symbol, last(close ORDER BY bar_ts) AS c FROM bars GROUP BY 1), ref AS (SELECT symbol, last(open ORDER BY bar_ts) AS c FROM bars WHERE symbol <> 'view' GROUP BY 1)
    SELECT symbol, bar_ts, close * coalesce(ref.c, 877.0) / last.c AS close FROM bars JOIN last USING (symbol) LEFT JOIN ref USING (symbol)""",
    "close",
    "bar_ts",
)
def cl16_rebase_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return C.rebase_to(b, b.where("symbol <> 'view'").withColumn("close", F.col("open"))).select("symbol", "bar_ts", "close")


@query(
    f"""WITH {TICKS}, one AS (SELECT * FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY event_id) = 1), {bars_cte("bars", "hour", "one")},
    m AS (SELECT *, median(close) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS med FROM bars)
    SELECT symbol, bar_ts, CASE WHEN abs(close - med) > 15 THEN CAST(round(CAST(med AS DECIMAL(18, 9)), 2) AS DOUBLE) ELSE close END AS close, volume,
    coalesce((epoch(bar_ts) - epoch(lag(bar_ts) OVER w)) / 60 > 60, FALSE) AS is_gap FROM m WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)""",
    "close volume",
    "bar_ts",
)
def cl17_clean_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_series(ticks(spark, sf_dir), "1 hour", gap=60.0).select("symbol", "bar_ts", "close", "volume", "is_gap")
