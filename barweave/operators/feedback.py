"""What had been learned of earlier forecasts at the moment of each new one.

A prediction counts from the time of the bar that resolves it, its step errors and model returns from the time of the
last bar that they need.  All of it is put on one time line for each series, and every moment takes the last values
before it; nothing that comes later is seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.functions.scratch import settled
from barweave.functions.windows import fill, running_sums, with_position
from barweave.operators import evaluation

KEY = ("symbol", "q_trading_date")


def learned(scored: DataFrame) -> DataFrame:
    """Scored rows (with actual_ts) with pos, the sum of their values, and both extrema biases after each."""
    flag = lambda c: F.coalesce(c, F.lit(0))
    value = 0.5 * flag("is_direction_correct") + 0.3 * flag("is_advice_correct") + 0.2 * flag("is_range_correct")
    d = scored.select("symbol", "target_time", "actual_ts", value.alias("value"), F.col("actual_price").alias("price"), F.col("upper_bound").alias("pred_high"), F.col("lower_bound").alias("pred_low"))
    d = evaluation.extrema_bias(d, order="target_time")
    return running_sums(with_position(d, order="target_time"), {"total": "value"}, order="target_time")


def as_of(scored: DataFrame, moments: DataFrame, least: int = 5, fallback: int = 30, idle: int = 20, every: str = "1 hour", day_start: int = 6) -> DataFrame:
    """(symbol, q_trading_date, win_rate, k, high_bias, low_bias, step_biases) of (symbol, q_trading_date, as_of) moments.

    The win rate is over rows due since the session's start at ``day_start``; over the last ``fallback`` rows where those
    are fewer than ``least``; over the last ``idle`` ones where no row was resolved within ``every``.  It is null before
    the first row is resolved, as the others are before anything is known.
    """
    rows = settled(learned(scored), "learned")
    steps = evaluation.step_biases(scored).select("symbol", F.col("closes_ts").alias("ts"), "target_time", F.col("biases").alias("step_biases"))
    steps = steps.groupBy("symbol", "ts").agg(F.max_by("step_biases", "target_time").alias("step_biases"))
    last = F.struct("pos", "total", "high_bias", "low_bias")
    resolved = rows.groupBy("symbol", F.col("actual_ts").alias("ts")).agg(F.max(last).alias("state"))
    due = rows.groupBy("symbol", F.col("target_time").alias("ts")).agg(F.max(F.struct("pos", "total")).alias("due"))
    start = F.date_trunc("day", F.col("as_of") - F.make_interval(hours=F.lit(day_start))) + F.make_interval(hours=F.lit(day_start))
    just = F.expr("INTERVAL 1 MICROSECOND")
    moment = lambda tag, ts: F.struct(F.lit(tag).alias("tag"), ts.alias("ts"))
    times = F.array(moment("now", F.col("as_of") + just), moment("before", F.col("as_of") - F.expr(f"INTERVAL {every}") + just), moment("session", start - just))
    asked = moments.select(*KEY, F.explode(times).alias("m")).select(*KEY, "m.tag", "m.ts")
    line = resolved.unionByName(steps, allowMissingColumns=True).unionByName(due, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
    found = fill(line, ["state", "step_biases", "due"]).where("tag is not null")
    pick = lambda tag, c: F.max(F.when(F.col("tag") == tag, F.col(c)))
    found = found.groupBy(*KEY).agg(pick("now", "state").alias("now"), pick("before", "state.pos").alias("before"), pick("session", "due").alias("session"), F.max_by("step_biases", F.when(F.col("tag") == "now", 1)).alias("step_biases"))
    found = settled(found, "found")
    back = found.select(*KEY, F.explode(F.array(*[F.struct(F.lit(n).alias("n"), (F.col("now.pos") - n).alias("pos")) for n in (fallback, idle)])).alias("b")).select(*KEY, "b.n", "b.pos")
    back = back.join(rows.select("symbol", "pos", "total"), ["symbol", "pos"]).groupBy(*KEY).agg(*[F.max(F.when(F.col("n") == n, F.col("total"))).alias(f"to_{n}") for n in (fallback, idle)])
    d = found.join(back, list(KEY), "left")
    n, total = F.col("now.pos") + 1, F.col("now.total")
    mean = lambda size: (total - F.coalesce(f"to_{size}", F.lit(0.0))) / F.least(n, F.lit(size))
    today = F.col("now.pos") - F.coalesce("session.pos", F.lit(-1))
    of_today = (total - F.coalesce("session.total", F.lit(0.0))) / today
    fresh = F.col("now.pos") > F.coalesce("before", F.lit(-1))
    rate = 100 * F.when(~fresh, mean(idle)).when(today >= least, of_today).otherwise(mean(fallback))
    d = d.select(*KEY, rate.alias("win_rate"), "now.high_bias", "now.low_bias", "step_biases")
    return d.withColumn("k", evaluation.dynamic_k(F.col("win_rate")))
