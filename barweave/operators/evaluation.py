"""The prediction log: recording, resolving, scoring, and what is fed back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barweave import config
from barweave.functions.columns import clip, rounded
from barweave.functions.windows import affine_scans, with_position
from barweave.operators.cleaning import asof_join


def direction(change: Column, flat: float = config.FLAT) -> Column:
    return F.when(F.abs(change) <= flat, "FLAT").when(change > 0, "UP").otherwise("DOWN")


def make_predictions(forecasts: DataFrame, flat: float = config.FLAT) -> DataFrame:
    """Forecasts with a target time, base price and predicted price (null or 0 don't count) as rows of the log."""
    present = F.col("target_time").isNotNull() & (F.coalesce("base_price", F.lit(0.0)) != 0) & (F.coalesce("predicted_price", F.lit(0.0)) != 0)
    return forecasts.where(present).withColumn("predicted_direction", direction(F.col("predicted_price") - F.col("base_price"), flat))


def resolve_actuals(pred: DataFrame, bars: DataFrame, now: Column | None = None, n: int = 6, times: bool = False) -> DataFrame:
    """Pending rows with target_time <= now (all of them without ``now``): actual_price (close of the first bar at or after
    it) and the next ``n`` closes; with ``times``, the times of that bar (actual_ts) and of the last of the closes (closes_ts).

    Rows without such a bar stay pending: both are null.  Bars that have positions keep them.
    """
    due = pred.where(F.col("actual_price").isNull() & (F.lit(True) if now is None else F.col("target_time") <= now)).drop("actual_price")
    d = (bars if "pos" in bars.columns else with_position(bars)).select("symbol", F.col("bar_ts").alias("ts"), "pos", "close")
    hit = asof_join(due.withColumn("ts", F.col("target_time")), d, ["pos"], forward=True).drop("ts")
    want = hit.where("pos is not null").select("symbol", "target_time", F.explode(F.sequence(F.col("pos"), F.col("pos") + n - 1)).alias("pos")).distinct()
    closes = want.join(d, ["symbol", "pos"]).groupBy("symbol", "target_time").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "close"))), lambda x: x["close"]).alias("closes"), F.max("ts").alias("closes_ts"))
    found = hit.drop("pos").withColumnRenamed("right_ts", "actual_ts").join(closes, ["symbol", "target_time"], "left").withColumn("actual_price", F.get("closes", F.lit(0)))
    return found if times else found.drop("actual_ts", "closes_ts")


def flags(flat: float = config.FLAT, lenient: float = 0.25) -> dict[str, Column]:
    """is_direction_correct, is_range_correct and is_advice_correct (0 or 1) of a row with an actual price."""
    change = F.col("actual_price") - F.col("base_price")
    actual, said, advice = direction(change, flat), F.col("predicted_direction"), F.col("advice_type")
    right = (actual == said) | (actual == "FLAT") | (said == "FLAT") | (F.abs(change) <= lenient)
    by_advice = (
        F.when(advice == "STRONG_BUY", change >= 0.10)
        .when(advice == "BUY_DIP", change >= -0.05)
        .when(advice == "STRONG_SELL", change <= -0.10)
        .when(advice == "SELL_RISK", change <= 0.05)
        .when(advice == "WAIT", F.abs(change) <= 0.80)
        .otherwise((actual == said) | (actual == "FLAT"))
    )
    each = {"is_direction_correct": right, "is_range_correct": F.col("actual_price").between(F.col("lower_bound"), F.col("upper_bound")), "is_advice_correct": by_advice}
    return {k: F.coalesce(v, F.lit(False)).cast("int") for k, v in each.items()}


def score_predictions(resolved: DataFrame, flat: float = config.FLAT, lenient: float = 0.25) -> DataFrame:
    """Adds the flags to rows with an actual price; others are left out."""
    return resolved.where("actual_price is not null").withColumns(flags(flat, lenient))


def win_rate(scored: DataFrame, session_start: Column, due: DataFrame | None = None, least: int = 5, fallback: int = 30, idle: int = 20) -> DataFrame:
    """(symbol, n, win_rate): 0.5 direction + 0.3 advice + 0.2 range, in percent, of rows due since the session's start; of the last
    ``fallback`` rows where those are fewer than ``least``; of the last ``idle`` rows for a series without a row in ``due``, the
    newly due ones.  The rank is limited to the last rows before they are shuffled."""
    flag = lambda c: F.coalesce(c, F.lit(0))
    value = 0.5 * flag("is_direction_correct") + 0.3 * flag("is_advice_correct") + 0.2 * flag("is_range_correct")
    d = scored.select("symbol", "target_time", value.alias("__v"))
    recent = d.withColumn("__k", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("target_time")))).where(F.col("__k") <= max(fallback, idle))

    def over(limit: int) -> Column:
        own = F.when(F.col("__k") <= limit, F.col("__v"))
        return F.struct(F.count(own).alias("n"), F.sum(own).alias("v"))

    last = recent.groupBy("symbol").agg(over(fallback).alias("__last"), over(idle).alias("__idle"))
    today = d.where(F.col("target_time") >= session_start).groupBy("symbol").agg(F.struct(F.count("*").alias("n"), F.sum("__v").alias("v")).alias("__today"))
    every = last.join(today, "symbol", "left")
    every = every.withColumn("__due", F.lit(True)) if due is None else every.join(due.select("symbol", F.lit(True).alias("__due")).distinct(), "symbol", "left")
    picked = F.when(F.col("__due").isNull(), F.col("__idle")).when(F.col("__today.n") >= least, F.col("__today")).otherwise(F.col("__last"))
    return every.select("symbol", picked.alias("__p")).select("symbol", F.col("__p.n").alias("n"), (F.col("__p.v") / F.col("__p.n") * 100).alias("win_rate"))


def dynamic_k(rate: Column) -> Column:
    """Band factor: wide for a low win rate, 2 digits."""
    low, high = config.K_AGGRESSIVE, config.K_DEFENSIVE
    return rounded(clip(low + (high - low) / (1 + F.exp((rate - 60) / 10)), low, high), 2)


def realized_returns(resolved: DataFrame, n: int = 6) -> DataFrame:
    """Adds returns: step returns of the n closes after the target; the change in equal parts where there are fewer."""
    eps = 1e-8
    c, base = F.col("closes"), F.col("base_price")
    before = lambda i: F.when(i == 1, base).otherwise(F.get(c, i - 2))
    steps = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (F.get(c, i - 1) - before(i)) / (before(i) + eps))
    equal = F.array_repeat((F.col("actual_price") - base) / (base + eps) / n, n)
    return resolved.withColumn("returns", F.when(F.size(c) == n, steps).otherwise(equal))


def step_biases(scored: DataFrame, alpha: float = 0.25, n: int = 6, order: str = "target_time") -> DataFrame:
    """Rows with ``n`` closes and biases: the smoothed error of the straight path to the forecast at each step so far.

    The steps' recurrences are one scan; rounding (4 digits) is done on output only.
    """
    base, end = F.col("base_price"), F.col("predicted_price")
    first = base + (end - base) * 0.167
    errors = {f"__b{i}": alpha * (first + (end - first) * i / (n - 1) - F.get("closes", F.lit(i))) for i in range(n)}
    d = scored.where(F.size("closes") == n).withColumns({"__a": F.lit(1 - alpha), **errors})
    d = affine_scans(d, {f"__x{i}": ("__a", f"__b{i}") for i in range(n)}, order=order)
    return d.withColumn("biases", F.array(*[rounded(f"__x{i}", 4) for i in range(n)])).drop("__a", *errors, *[f"__x{i}" for i in range(n)])


def step_bias(scored: DataFrame, alpha: float = 0.25, n: int = 6, order: str = "target_time") -> DataFrame:
    """(symbol, target_time, step, bias) of ``step_biases``, a row for each step."""
    d = step_biases(scored, alpha, n, order).select("symbol", order, F.posexplode("biases").alias("step", "bias"))
    return d.withColumn("step", F.col("step") + 1)


def extrema_bias(df: DataFrame, fast: float = 0.3, slow: float = 0.7, trigger: float = 3.0, order: str = "bar_ts") -> DataFrame:
    """Adds high_bias and low_bias after each (price, pred_high, pred_low): fast when a bound is breached, slow when it is
    further than ``trigger`` away, else unchanged."""
    p, hi, lo = F.col("price"), F.col("pred_high"), F.col("pred_low")
    known = hi.isNotNull() & lo.isNotNull()
    over, far_below = known & (p > hi), known & (p < hi - trigger)
    under, far_above = known & (p < lo), known & (p > lo + trigger)

    def pair(hit: Column, far: Column, gap: Column) -> tuple[Column, Column]:
        a = F.when(hit, slow).when(far, 1 - slow).otherwise(1.0)
        b = F.when(hit, fast * gap).when(far, slow * gap * 0.1).otherwise(0.0)
        return a, F.coalesce(b, F.lit(0.0))

    (ha, hb), (la, lb) = pair(over, far_below, p - hi), pair(under, far_above, p - lo)
    d = df.withColumns({"__ha": ha, "__hb": hb, "__la": la, "__lb": lb})
    d = affine_scans(d, {"high_bias": ("__ha", "__hb"), "low_bias": ("__la", "__lb")}, order=order)
    return d.drop("__ha", "__hb", "__la", "__lb")


def mape_check(df: DataFrame, by: tuple[str, ...] = ("symbol",), order: str = "bar_ts", limit: float = 0.005) -> DataFrame:
    """(mape, last_error, mean_error, rematch) of actual against predicted; zeros for an empty group."""
    gap = F.col("actual") - F.col("predicted")
    out = df.groupBy(*by).agg(F.avg(F.abs(gap / (F.col("actual") + 1e-8))).alias("mape"), F.max_by(gap, order).alias("last_error"), F.avg(gap).alias("mean_error"))
    out = out.na.fill(0.0, ["mape", "last_error", "mean_error"])
    return out.withColumn("rematch", F.col("mape") > limit)


def review_log(scored: DataFrame, n: int = 10) -> DataFrame:
    """(symbol, k, line): the latest ``n`` scored rows of each series as text."""
    d = scored.withColumn("k", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("target_time")))).where(F.col("k") <= n)
    hit = F.when(F.col("is_direction_correct") == 1, "hit").otherwise("miss")
    arrow = F.when(F.col("predicted_direction") == "UP", "^").when(F.col("predicted_direction") == "DOWN", "v").otherwise("-")
    mark = F.when(F.col("is_advice_correct") == 1, "ok").otherwise("no")
    return d.select("symbol", "k", F.format_string("[%s] %s %s (%s %s)", F.date_format("target_time", "HH:mm"), hit, arrow, F.coalesce("advice_type", F.lit("none")), mark).alias("line"), "predicted_price", "actual_price")
