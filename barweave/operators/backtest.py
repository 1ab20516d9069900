"""Walk-forward backtest in one pass over history, and its metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barweave import config
from barweave.functions.scratch import settled
from barweave.functions.windows import affine_scans
from barweave.operators import forecast, matching
from barweave.operators.cleaning import asof_join

KEY = ("symbol", "q_trading_date")


def backtest(bars: DataFrame, n: int, steps: int = config.FUTURE_STEPS, k: int = 3, radius: int = config.NMS_RADIUS, dtw_radius: int | None = None, cutoffs: int | None = None, replay: bool = False) -> DataFrame:
    """(symbol, q_trading_date, last_price, predicted_end, actual_end, mape) for every day with matches and a full future.

    Every day is a cut-off; with ``cutoffs``, that many of each series, evenly spaced from the first to the last.
    Candidates are earlier days only, and their futures end before the query's last bar, so nothing later than the
    cut-off is seen.  With ``replay``, corrected_end and corrected_mape are added, see ``replayed``.
    """
    bars = settled(forecast.placed(bars), "bars")
    windows = settled(matching.day_windows(bars, n), "windows")
    matches = matching.match_days(bars, n, k, radius=radius, dtw_radius=dtw_radius, past_only=True)
    matches = matches.where(F.col("h_start_pos") + n + steps <= F.col("q_start_pos") + n)
    if cutoffs is not None:
        matches = matches.join(evenly_spaced(windows, cutoffs), list(KEY), "left_semi")
    matches = settled(matches, "matches")
    queries = settled(forecast.query_prices(bars, windows, n), "queries")
    paths = forecast.project_path(forecast.vol_ratio(forecast.match_future(forecast.softmax_weights(matches), bars, n, steps), bars, queries, n), steps)
    predicted = forecast.ensemble_path(paths, steps).join(queries.select(*KEY, "last_pos", "as_of", "last_price"), list(KEY))
    actual = bars.select("symbol", F.col("pos").alias("__pos"), F.col("close").alias("actual"), F.col("bar_ts").alias("__ts"))
    both = predicted.withColumn("__pos", F.col("last_pos") + F.col("step")).join(actual, ["symbol", "__pos"])
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("step", c))), lambda x: x[c])
    done = both.groupBy(*KEY, "last_price", "as_of").agg(ordered("matcher").alias("predicted"), ordered("actual").alias("actual"), F.max("__ts").alias("known_at"))
    done = done.where(F.size("actual") == steps)
    ends = {"predicted_end": F.element_at("predicted", -1), "actual_end": F.element_at("actual", -1), "mape": _mape("predicted")}
    if not replay:
        return done.withColumns(ends).select(*KEY, "last_price", *ends)
    done = replayed(settled(done, "results"), steps)
    ends |= {"corrected_end": F.element_at("corrected", -1), "corrected_mape": _mape("corrected")}
    return done.withColumns(ends).select(*KEY, "last_price", *ends)


def _mape(path: str) -> Column:
    gaps = F.zip_with(path, "actual", lambda p, a: F.abs(p - a) / a)
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size(path) * 100


def replayed(results: DataFrame, steps: int, alpha: float = 0.25) -> DataFrame:
    """Adds corrected: each cut-off's path less the step biases learned from the results that were known at it.

    A result is known from the time of its last actual bar on; biases are smoothed over results in that order, so a
    replay of the cut-offs one after another gives the same.
    """
    errors = {f"__b{i}": alpha * (F.get("predicted", F.lit(i)) - F.get("actual", F.lit(i))) for i in range(steps)}
    d = results.select(*KEY, "known_at", F.lit(1 - alpha).alias("__a"), *[e.alias(c) for c, e in errors.items()])
    d = affine_scans(d, {f"__x{i}": ("__a", f"__b{i}") for i in range(steps)}, order="known_at")
    learned = d.select("symbol", F.col("known_at").alias("ts"), F.array(*[f"__x{i}" for i in range(steps)]).alias("biases"))
    found = asof_join(results.withColumn("ts", F.col("as_of")), learned, ["biases"])
    bias = lambda i: F.coalesce(F.get("biases", i), F.lit(0.0))
    return found.withColumn("corrected", F.transform("predicted", lambda p, i: p - bias(i))).drop("ts", "right_ts", "biases")


def evenly_spaced(windows: DataFrame, cutoffs: int) -> DataFrame:
    """(symbol, q_trading_date) of ``cutoffs`` days of each series, evenly spaced, first and last included."""
    days = windows.select("symbol", F.col("trading_date").alias("q_trading_date"))
    w = W.partitionBy("symbol")  # one row a day
    d = days.withColumns({"__i": F.row_number().over(w.orderBy("q_trading_date")) - 1, "__n": F.count("*").over(w)})
    # day i is taken where a multiple of (n - 1) / (cutoffs - 1), cut to a whole number, is i
    wanted = F.transform(F.sequence(F.lit(0), F.lit(cutoffs - 1)), lambda j: F.floor(j * (F.col("__n") - 1) / max(cutoffs - 1, 1)))
    return d.where(F.array_contains(wanted, F.col("__i").cast("long"))).select(*KEY)


def backtest_metrics(results: DataFrame, min_move: float = 0.05, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(n, mape, signals, win_rate, mean_return, sharpe): a forecast beyond ``min_move`` is a signal; its return takes the
    forecast's sign; Sharpe is scaled to years of minutes."""
    said, came = F.col("predicted_end") - F.col("last_price"), F.col("actual_end") - F.col("last_price")
    d = results.withColumns({"__s": F.abs(said) > min_move, "__hit": F.signum(said) == F.signum(came), "__r": F.signum(said) * came / F.col("last_price")})
    taken = F.when(F.col("__s"), F.col("__r"))
    n = F.count_if("__s")
    sharpe = F.when(n > 1, F.avg(taken) / (F.stddev_pop(taken) + 1e-8) * (252 * 1440) ** 0.5).otherwise(0.0)
    won = F.when(n > 0, F.count_if(F.col("__s") & F.col("__hit")) / n * 100).otherwise(0.0)
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("mape").alias("mape"), n.alias("signals"), won.alias("win_rate"), F.coalesce(F.avg(taken), F.lit(0.0)).alias("mean_return"), sharpe.alias("sharpe"))
