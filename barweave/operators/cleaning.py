"""Parsing, units, alignment and cleaning of quotes and bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barweave import config
from barweave.functions.columns import rounded
from barweave.functions.scratch import settled
from barweave.functions.windows import fill, in_chunks, month
from barweave.operators.calendar import tail

OHLC = ("open", "high", "low", "close")


def _number(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[+-]?\d+(\.\d*)?([eE][+-]?\d+)?\s*$"), text.try_cast("double"))


def parse_quotes(df: DataFrame, kind: str, col: str = "raw") -> DataFrame:
    """Adds ``price`` from quote text of one kind; what can't be parsed is null.

    rate: ``var="a,b,c,d"``, field 1, or field 3 where that isn't positive.  metal: the same text, field 0, of 13 fields
    at least.  tilde: field 3 of ``a~b~c~d``.  json: ``data.f43`` in ten-thousandths.
    """
    raw = F.col(col)
    fields = F.split(F.regexp_extract(raw, '="([^"]*)"', 1), ",")
    field = lambda k: _number(F.get(fields, F.lit(k)))
    if kind == "rate":
        price = F.when(field(1) > 0, field(1)).otherwise(field(3))
    elif kind == "metal":
        price = F.when(F.size(fields) >= 13, field(0))
    elif kind == "tilde":
        price = _number(F.get(F.split(raw, "~"), F.lit(3)))
    elif kind == "json":
        price = _number(F.get_json_object(raw, "$.data.f43")) / 10000
    else:
        raise ValueError(kind)
    return df.withColumn("price", price)


def pick_rate(quotes: DataFrame, priority: Sequence[str], as_of: Column, ttl_s: int = 60, default: float = config.DEFAULT_RATE, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """One rate for each key: the first source in ``priority`` with a positive rate no older than ``ttl_s``; else the default."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("source"))
    age = F.unix_timestamp(as_of) - F.unix_timestamp("ts")
    usable = (F.col("rate") > 0) & (rank > 0) & age.between(0, ttl_s)
    best = F.min_by(F.when(usable, F.col("rate")), F.when(usable, F.struct(rank, age)))
    return quotes.groupBy(*by).agg(F.coalesce(best, F.lit(default)).alias("rate"))


def quote_to_bar(df: DataFrame) -> DataFrame:
    """A snapshot quote as a one-minute bar of volume 1; prices that aren't positive are rejected."""
    p = F.col("price")
    return df.where(p > 0).select("symbol", F.date_trunc("minute", "ts").alias("bar_ts"), *[p.alias(c) for c in OHLC], F.lit(1.0).alias("volume"))


def convert_units(df: DataFrame, rate: Column, factor: float = config.OUNCE_GRAMS, digits: int | None = None, cols: Sequence[str] = OHLC) -> DataFrame:
    """Prices times ``rate`` over ``factor``; volume stays.  Rounds half to even where ``digits`` is given."""
    scaled = lambda c: F.col(c) * rate / factor
    return df.withColumns({c: scaled(c) if digits is None else F.bround(scaled(c), digits) for c in cols})


def pivot_tickers(quotes: DataFrame, tickers: Sequence[str], value: str = "close", ts: str = "bar_ts") -> DataFrame:
    """One row for each timestamp with a column for each ticker, null where it has none."""
    return quotes.groupBy(ts).pivot("symbol", list(tickers)).agg(F.first(value))


def fill_forward(df: DataFrame, cols: list[str], by: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    return fill(df, cols, True, by, order)


def fill_backward(df: DataFrame, cols: list[str], by: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    return fill(df, cols, False, by, order)


def asof_join(left: DataFrame, right: DataFrame, values: list[str], by: tuple[str, ...] = ("symbol",), order: str = "ts", forward: bool = False, tolerance_s: int | None = None, unit: str = "month") -> DataFrame:
    """``left`` with ``values`` of the last right row at or before it (``forward``: the first at or after), or nulls.

    Both sides are stacked and filled, so a row is never paired with more than one other.  Right rows of one time are
    one row: the largest of their values in column order.  Left rows without a time stay, with nulls.

    Rows meet in ranges of time (``unit``: month, day, hour), and each range's last right row travels on to the next.
    Without ``by``, all left rows share one right table: no right row is copied, and the ranges are the tasks.
    """
    one = right.where(F.col(order).isNotNull()).groupBy(*by, order).agg(F.max(F.struct(*values)).alias("__v"))
    one = one.select(*by, order, F.struct(F.col(order).alias("__at"), "__v").alias("__r"))
    rows = left.select(*by, order, F.struct(*left.columns).alias("__left"), F.lit(None).cast(one.schema["__r"].dataType).alias("__r"), F.lit(0 if forward else 1).alias("__side"))
    both = rows.unionByName(one.withColumns({"__left": F.lit(None).cast(rows.schema["__left"].dataType), "__side": F.lit(1 if forward else 0)}))
    both = both.withColumn("__order", F.struct(order, "__side")).withColumn("__month", month(order, unit))
    inside, months = W.partitionBy(*by, "__month").orderBy("__order"), W.partitionBy(*(by or (F.lit(0),))).orderBy("__month")
    span, travel = ((0, W.unboundedFollowing), (1, W.unboundedFollowing)) if forward else ((W.unboundedPreceding, 0), (W.unboundedPreceding, -1))
    pick = F.first if forward else F.last
    edge = F.min_by if forward else F.max_by
    ends = both.groupBy(*by, "__month").agg(edge("__r", F.when(F.col("__r").isNotNull(), F.col("__order"))).alias("__e"))
    carried = ends.select(*by, "__month", pick("__e", ignorenulls=True).over(months.rowsBetween(*travel)).alias("__c"))
    both = both.withColumn("__in", pick("__r", ignorenulls=True).over(inside.rowsBetween(*span))).join(carried, [*by, "__month"])
    hit = F.coalesce("__in", "__c")
    if tolerance_s is not None:
        gap = F.abs(F.unix_timestamp(order) - F.unix_timestamp(hit["__at"]))
        hit = F.when(gap <= tolerance_s, hit)
    found = both.where(F.col("__left").isNotNull()).select("__left.*", hit.alias("__hit"))
    return found.select(*left.columns, F.col("__hit.__at").alias("right_ts"), *[F.col(f"__hit.__v.{v}").alias(v) for v in values])


def to_local(df: DataFrame, col: str, zone: str = "Asia/Shanghai") -> DataFrame:
    """Adds ``local_ts`` (wall clock) and ``local_iso``; input without a zone is UTC."""
    local = F.from_utc_timestamp(col, zone)
    return df.withColumns({"local_ts": local, "local_iso": F.date_format(local, "yyyy-MM-dd HH:mm:ss")})


def merge_sources(dfs: Sequence[DataFrame], by: tuple[str, ...] = ("symbol", "bar_ts")) -> DataFrame:
    """All rows of the feeds; where they have one key, the earlier feed in the list wins."""
    tagged = [d.withColumn("__p", F.lit(k)) for k, d in enumerate(dfs)]
    every = tagged[0]
    for d in tagged[1:]:
        every = every.unionByName(d)
    rest = [c for c in dfs[0].columns if c not in by]
    return every.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct("__p", *rest)).alias("__r")).select(*by, "__r.*")


def dedupe_bars(df: DataFrame, by: tuple[str, ...] = ("symbol", "ts"), order: str = "event_id") -> DataFrame:
    """One row for each key: the first by ``order``.  Partial aggregation keeps repeated keys from being shuffled."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("__r")).select(*by, "__r.*")


def coerce_time(df: DataFrame, col: str) -> DataFrame:
    """Text to timestamp; rows that aren't one are dropped."""
    return df.withColumn(col, F.try_to_timestamp(F.col(col), F.lit("yyyy-MM-dd HH:mm:ss"))).where(F.col(col).isNotNull())


def resample_ohlcv(df: DataFrame, width: str, by: tuple[str, ...] = ("symbol",), tie: str = "event_id") -> DataFrame:
    """Left-closed, left-labelled bars of ticks; empty buckets have no row.  Two-phase, so only bars are shuffled."""
    at = F.struct("ts", tie)
    out = df.groupBy(*by, F.window("ts", width).alias("__w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume")
    )
    return out.select(*by, F.col("__w.start").alias("bar_ts"), *OHLC, "volume")


def resample_bars(df: DataFrame, width: str, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Wider bars of bars."""
    out = df.groupBy(*by, F.window("bar_ts", width).alias("__w")).agg(
        F.min_by("open", "bar_ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_ts").alias("close"), F.sum("volume").alias("volume")
    )
    return out.select(*by, F.col("__w.start").alias("bar_ts"), *OHLC, "volume")


def upsample_interpolate(df: DataFrame, width: str, max_gap: str | None = None, cols: Sequence[str] = (*OHLC, "volume")) -> DataFrame:
    """A regular grid from the first to the last bar, linear in time; across gaps too, unless longer than ``max_gap``.

    Bars must lie on the grid.  Each bar makes the points up to the next one, so no row sees more than its neighbour.
    """

    def spread(d: DataFrame, w: W) -> DataFrame:
        return d.withColumns({"__next": F.lead("bar_ts").over(w)} | {f"__{c}": F.lead(c).over(w) for c in cols})

    d = in_chunks(df.select("symbol", "bar_ts", *cols), spread, 0, 1).drop("pos")
    step = F.expr(f"INTERVAL {width}")
    near = F.lit(True) if max_gap is None else F.col("__next") <= F.col("bar_ts") + F.expr(f"INTERVAL {max_gap}")
    end = F.when(F.col("__next").isNotNull() & near, F.col("__next") - step).otherwise(F.col("bar_ts"))
    d = d.withColumn("__t", F.explode(F.sequence("bar_ts", end, step)))
    share = (F.unix_timestamp("__t") - F.unix_timestamp("bar_ts")) / (F.unix_timestamp("__next") - F.unix_timestamp("bar_ts"))
    mixed = [F.when(F.col("__t") == F.col("bar_ts"), F.col(c)).otherwise(F.col(c) + (F.col(f"__{c}") - F.col(c)) * share).alias(c) for c in cols]
    return d.select("symbol", F.col("__t").alias("bar_ts"), *mixed)


def filter_spikes(df: DataFrame, window: int = 11, limit: float = 15.0) -> DataFrame:
    """Where the close is further than ``limit`` from the centred median, all four prices become the median (2 digits)."""
    half = window // 2

    def clean(d: DataFrame, w: W) -> DataFrame:
        d = d.withColumn("__med", F.percentile("close", F.lit(0.5)).over(w.rowsBetween(-half, half)))
        spike = F.abs(F.col("close") - F.col("__med")) > limit
        return d.withColumn("is_spike", spike).withColumns({c: F.when(F.col("is_spike"), rounded("__med", 2)).otherwise(F.col(c)) for c in OHLC}).drop("__med")

    return in_chunks(df, clean, half, half).drop("pos")


def flag_gaps(df: DataFrame, minutes: float = config.GAP_MINUTES) -> DataFrame:
    """Adds time_diff (minutes to the previous bar, null for the first) and is_gap."""

    def flag(d: DataFrame, w: W) -> DataFrame:
        diff = (F.unix_timestamp("bar_ts") - F.unix_timestamp(F.lag("bar_ts").over(w))) / 60.0
        return d.withColumn("time_diff", diff).withColumn("is_gap", F.coalesce(F.col("time_diff") > minutes, F.lit(False)))

    return in_chunks(df, flag, 1).drop("pos")


def rebase_to(df: DataFrame, reference: DataFrame, default: float = 877.0) -> DataFrame:
    """Prices scaled so that each series ends at its reference's last price (no reference: the default)."""
    last = df.groupBy("symbol").agg(F.max_by("close", "bar_ts").alias("__last"))
    ref = reference.groupBy("symbol").agg(F.max_by("close", "bar_ts").alias("__ref"))
    ratio = last.join(ref, "symbol", "left").select("symbol", (F.coalesce("__ref", F.lit(default)) / F.col("__last")).alias("__ratio"))
    return df.join(ratio, "symbol").withColumns({c: F.col(c) * F.col("__ratio") for c in OHLC}).drop("__ratio")


def clean_series(ticks: DataFrame, width: str, window: int = 11, limit: float = 15.0, gap: float = config.GAP_MINUTES) -> DataFrame:
    """Ticks to a clean series: one row a timestamp, bars, spikes replaced, gaps flagged."""
    bars = resample_ohlcv(dedupe_bars(ticks), width)
    return flag_gaps(filter_spikes(bars, window, limit).drop("is_spike"), gap)


def refresh_marks(snapshot: DataFrame, window: int = 11) -> DataFrame:
    """(symbol, __from, __keep) of each series: where rebuilding begins (2 * window bars before the newest one), and from
    where rebuilt rows take the place of old ones (half a window before it)."""
    half = window // 2
    newest = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("bar_ts")))
    last = tail(snapshot.select("symbol", "bar_ts"), 2 * window).withColumn("n", newest)
    return last.groupBy("symbol").agg(F.min("bar_ts").alias("__from"), F.min(F.when(F.col("n") <= half + 1, F.col("bar_ts"))).alias("__keep"))


def _rebuilt(marks: DataFrame, ticks: DataFrame, width: str, window: int, limit: float, gap: float) -> DataFrame:
    recent = ticks.join(marks, "symbol", "left").where(F.col("__from").isNull() | (F.col("ts") >= F.col("__from"))).drop("__from", "__keep")
    done = clean_series(recent, width, window, limit, gap).join(marks, "symbol", "left")
    return done.where(F.col("__keep").isNull() | (F.col("bar_ts") >= F.col("__keep"))).drop("__from", "__keep")


def incremental_refresh(snapshot: DataFrame, ticks: DataFrame, width: str, window: int = 11, limit: float = 15.0, gap: float = config.GAP_MINUTES) -> DataFrame:
    """A clean snapshot brought up to date, equal to a full rebuild.

    New bars, the last open bar and the halo that their medians need are rebuilt; older rows are kept.  Each series is
    rebuilt from 2 * window bars before its newest one, of which the first window only serve as halo.
    """
    marks = refresh_marks(snapshot, window)
    rebuilt = _rebuilt(marks, ticks, width, window, limit, gap)
    kept = snapshot.join(marks, "symbol").where(F.col("bar_ts") < F.col("__keep"))
    return kept.select(*snapshot.columns).unionByName(rebuilt.select(*snapshot.columns))


MARKS = "_marks"


def write_months(clean: DataFrame, path: str, window: int = 11) -> None:
    """A clean snapshot as month partitions, with the marks of its series beside them for ``refresh_months``."""
    clean.withColumn("month", F.date_format("bar_ts", "yyyy-MM")).write.mode("overwrite").partitionBy("month").parquet(path)
    refresh_marks(clean.sparkSession.read.parquet(path), window).write.mode("overwrite").parquet(f"{path}/{MARKS}")


def refresh_months(spark: SparkSession, path: str, ticks: DataFrame, width: str, window: int = 11, limit: float = 15.0, gap: float = config.GAP_MINUTES) -> list[str]:
    """Brings the table of ``write_months`` up to date and returns the months that were read and written again.

    The marks say from where each series is rebuilt, so ticks before them and months before the first rebuilt bar are
    never read; a month that no new bar touches keeps its files.  Equal to a full rebuild; a repeated call changes
    nothing.  The months, few beside the rows, are all that reaches the driver.
    """
    marks = settled(spark.read.parquet(f"{path}/{MARKS}"), "marks")
    start = marks.agg(F.min("__from"), F.min("__keep")).first()
    known = marks.select("symbol")
    late = ticks.join(known, "symbol", "left_semi").where(F.col("ts") >= F.lit(start[0])).unionByName(ticks.join(known, "symbol", "left_anti"))
    rebuilt = settled(_rebuilt(marks, late, width, window, limit, gap).withColumn("month", F.date_format("bar_ts", "yyyy-MM")), "rebuilt")
    months = sorted(r[0] for r in rebuilt.select("month").distinct().collect())
    old = spark.read.schema(rebuilt.schema).option("basePath", path).parquet(path).where(F.col("month").isin(months))
    kept = old.join(marks, "symbol", "left").where(F.col("__keep").isNull() | (F.col("bar_ts") < F.col("__keep"))).select(*rebuilt.columns)
    new = settled(kept.unionByName(rebuilt), "months")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    # marks of series with new bars come from the months just written, those of others stay
    fresh = refresh_marks(new.join(rebuilt.select("symbol").distinct(), "symbol", "left_semi"), window)
    n = new.groupBy("symbol").count().where(F.col("count") < 2 * window).select("symbol")
    short = fresh.join(n, "symbol", "left_semi").join(marks.select("symbol", F.col("__from").alias("__f"), F.col("__keep").alias("__k")), "symbol", "left")
    short = short.select("symbol", F.least("__from", "__f").alias("__from"), F.least("__keep", F.coalesce("__k", "__keep")).alias("__keep"))
    every = fresh.join(n, "symbol", "left_anti").unionByName(short).unionByName(marks.join(rebuilt.select("symbol").distinct(), "symbol", "left_anti"))
    settled(every, "marks").write.mode("overwrite").parquet(f"{path}/{MARKS}")
    return months
