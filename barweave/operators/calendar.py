"""Trading days, sessions, slices and time axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barweave import config
from barweave.functions.windows import month


def trading_date(ts: Column | str, start_hour: int = config.DAY_START_HOUR) -> Column:
    """The date of the trading day, which starts at ``start_hour``."""
    return F.to_date((F.col(ts) if isinstance(ts, str) else ts) - F.expr(f"INTERVAL {start_hour} HOURS"))


def session_position(df: DataFrame, start_hour: int = config.DAY_START_HOUR) -> DataFrame:
    """Adds trading_date, session_pos (1-based), day_bars, and is_last_day of the series."""
    day = W.partitionBy("symbol", "trading_date")
    d = df.withColumn("trading_date", trading_date("bar_ts", start_hour))
    last = d.groupBy("symbol").agg(F.max("trading_date").alias("__last"))
    d = d.withColumns({"session_pos": F.row_number().over(day.orderBy("bar_ts")), "day_bars": F.count("*").over(day)})
    return d.join(last, "symbol").withColumn("is_last_day", F.col("trading_date") == F.col("__last")).drop("__last")


def tail(df: DataFrame, n: int | DataFrame, order: str = "bar_ts") -> DataFrame:
    """The last ``n`` rows of each series, or of (symbol, n) rows as many as each says.  Whole months that can't hold one
    of them are pruned before ranking."""
    d = df.withColumn("__month", month(order))
    counts = d.groupBy("symbol", "__month").agg(F.count("*").alias("__m"))
    counts = counts.withColumn("__want", F.lit(n)) if isinstance(n, int) else counts.join(n.select("symbol", F.col("n").alias("__want")), "symbol")
    later = W.partitionBy("symbol").orderBy(F.desc("__month")).rowsBetween(W.unboundedPreceding, -1)
    near = counts.withColumn("__later", F.coalesce(F.sum("__m").over(later), F.lit(0))).where("__later < __want").select("symbol", "__month", "__want")
    rank = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc(order)))
    return d.join(near, ["symbol", "__month"]).withColumn("__r", rank).where("__r <= __want").drop("__r", "__month", "__want")


def current_query(df: DataFrame, min_points: int = config.MIN_SESSION_POINTS, borrow: bool = True) -> DataFrame:
    """(symbol, n, closes): the last N closes, N = bars of the last trading day, but ``min_points`` at least where
    bars may be borrowed from the day before.  Only the months that hold them are ranked."""
    days = df.groupBy("symbol", trading_date("bar_ts").alias("__day")).agg(F.count("*").alias("__n"))
    today = days.groupBy("symbol").agg(F.max_by("__n", "__day").alias("__today"))
    want = F.greatest("__today", F.lit(min_points)) if borrow else F.col("__today")
    recent = tail(df, today.select("symbol", want.alias("n")))
    closes = F.transform(F.sort_array(F.collect_list(F.struct("bar_ts", "close"))), lambda x: x["close"])
    return recent.groupBy("symbol").agg(F.count("*").alias("n"), closes.alias("closes"))


def slice_range(bars: DataFrame, ranges: DataFrame) -> DataFrame:
    """Bars with start <= bar_ts <= end for many (request, symbol, start, end) at once.

    A request is an equi-join on the days that it touches, then a filter; never a join on inequality alone.
    """
    days = F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("__day")
    asked = ranges.where(F.col("start") <= F.col("end")).select("request", "symbol", "start", "end", days)
    d = bars.withColumn("__day", F.to_date("bar_ts"))
    return d.join(asked, ["symbol", "__day"]).where(F.col("bar_ts").between(F.col("start"), F.col("end"))).drop("__day", "start", "end")


def future_axis(df: DataFrame, steps: int = config.FUTURE_STEPS, width: str = config.BAR) -> DataFrame:
    """(symbol, step, ts, iso, label): the timestamps after each series' last bar."""
    last = df.groupBy("symbol").agg(F.max("bar_ts").alias("last"))
    step = F.expr(f"INTERVAL {width}")
    axis = last.select("symbol", F.posexplode(F.sequence(F.col("last") + step, F.col("last") + step * steps, step)).alias("k", "ts"))
    return axis.select("symbol", (F.col("k") + 1).alias("step"), "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("iso"), F.date_format("ts", "HH:mm").alias("label"))


def axis_labels(df: DataFrame) -> DataFrame:
    """Adds ``label``: the time on the date of the series' last bar, date and time before."""
    last = df.groupBy("symbol").agg(F.max("bar_ts").alias("__last"))
    same = F.to_date("bar_ts") == F.to_date("__last")
    label = F.when(same, F.date_format("bar_ts", "HH:mm")).otherwise(F.date_format("bar_ts", "MM-dd HH:mm"))
    return df.join(last, "symbol").withColumn("label", label).drop("__last")


def steps_left(ts: Column, width_s: int = 60, floor: int = 6) -> Column:
    """Bars until 23:59:59 of the bar's date, ``floor`` at least."""
    end = F.unix_timestamp(F.date_trunc("day", ts)) + 86399
    return F.greatest(F.floor((end - F.unix_timestamp(ts)) / width_s), F.lit(floor)).cast("long")


def require_history(df: DataFrame, n: int = config.WINDOW) -> DataFrame:
    """Series of ``n`` bars at least."""
    enough = df.groupBy("symbol").agg(F.count("*").alias("__n")).where(F.col("__n") >= n).select("symbol")
    return df.join(enough, "symbol", "left_semi")
