"""From matched days to a forecast: projected paths, blend, bands, votes, extrema and advice.

A forecast is keyed by (symbol, q_trading_date).  Matches are few rows a query; bars are only ever met by equi-join on
positions, so nothing is broadcast by hand and no query sees more than its own matches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barweave import config
from barweave.functions.columns import clip, rounded
from barweave.functions.scratch import settled
from barweave.functions.windows import carried, in_chunks, running_sums, with_position
from barweave.operators import features

KEY = ("symbol", "q_trading_date")
SHORT_STEPS = 10


def softmax_weights(matches: DataFrame) -> DataFrame:
    """Adds weight: softmax of similarity at a temperature of 1.5 * deviation + 2.5, in 2.5..6 (3.5 for one match)."""
    w = W.partitionBy(*KEY)
    tau = F.when(F.count("*").over(w) > 1, clip(F.stddev_pop("similarity").over(w) * 1.5 + 2.5, 2.5, 6.0)).otherwise(3.5)
    d = matches.withColumn("tau", tau).withColumn("__e", F.exp((F.col("similarity") - F.max("similarity").over(w)) / F.col("tau")))
    return d.withColumn("weight", F.col("__e") / F.sum("__e").over(w)).drop("__e")


def placed(bars: DataFrame) -> DataFrame:
    """Bars with pos and the sums up to each bar of absolute changes (moved) and of closes (closes); a frame that has them
    stays as it is, so that it can be written once."""
    if {"pos", "moved", "closes"} <= set(bars.columns):
        return bars
    step = lambda d, w: d.withColumn("__move", F.coalesce(F.abs(F.col("close") - F.lag("close").over(w)), F.lit(0.0)))
    return running_sums(in_chunks(bars, step, behind=1), {"moved": "__move", "closes": "close"}).drop("__move")


def query_prices(bars: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """(symbol, q_trading_date, last_pos, as_of, last_price, abs_move, vol30, velocity, n_bars): each query's state at its n-th bar."""
    spread = F.stddev_pop("close")
    frame = lambda d, w: d.withColumns({"vol30": F.when(F.col("pos") >= 29, spread.over(w.rowsBetween(-29, 0))), "velocity": (F.col("close") - F.lag("close", 4).over(w)) / 5})
    state = features.apply(placed(bars), features.recent_abs_move(), frame, behind=30, positioned=True)
    state = state.select("symbol", F.col("pos").alias("last_pos"), F.col("bar_ts").alias("as_of"), F.col("close").alias("last_price"), "abs_move", "vol30", F.coalesce("velocity", F.lit(0.0)).alias("velocity"), (F.col("pos") + 1).alias("n_bars"))
    q = windows.select("symbol", F.col("trading_date").alias("q_trading_date"), (F.col("start_pos") + n - 1).alias("last_pos"))
    return q.join(state, ["symbol", "last_pos"])


def match_future(matches: DataFrame, bars: DataFrame, n: int, steps: int = config.FUTURE_STEPS) -> DataFrame:
    """Adds anchor (close at the matched window's end) and future (``steps`` closes after it, the last one repeated).

    A match at the very end of history carries its anchor.
    """
    d = placed(bars).select("symbol", "pos", "close")
    want = matches.select(*KEY, "rank", F.explode(F.sequence(F.col("h_start_pos") + n - 1, F.col("h_start_pos") + n - 1 + steps)).alias("pos"))
    got = want.join(d, ["symbol", "pos"]).groupBy(*KEY, "rank").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "close"))), lambda x: x["close"]).alias("__p"))
    p = F.col("__p")
    future = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: p[F.least(i, F.size(p) - 1)])
    return matches.join(got.select(*KEY, "rank", p[0].alias("anchor"), future.alias("future")), [*KEY, "rank"])


def vol_ratio(matches: DataFrame, bars: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """Adds ratio: recent mean absolute move over that of the matched window, in 0.75..1.25; 1 for a still window.

    The window's mean is a difference of running sums, so a match looks up two bars.
    """
    ends = matches.select(*KEY, "rank", F.explode(F.array(F.col("h_start_pos"), F.col("h_start_pos") + n - 1)).alias("pos"))
    hist = ends.join(placed(bars).select("symbol", "pos", "moved"), ["symbol", "pos"]).groupBy(*KEY, "rank")
    hist = hist.agg(((F.max("moved") - F.min("moved")) / (n - 1)).alias("__h"))
    d = matches.join(hist, [*KEY, "rank"], "left").join(queries.select(*KEY, "last_price", "abs_move"), list(KEY))
    return d.withColumn("ratio", F.when(F.col("__h") > 1e-4, clip(F.col("abs_move") / F.col("__h"), 0.75, 1.25)).otherwise(1.0)).drop("__h")


def project_path(d: DataFrame, steps: int = config.FUTURE_STEPS, limit: float = 0.35) -> DataFrame:
    """Adds path and returns: differences of the matched future, scaled by ratio (short horizons limited by step), added up
    from the current price."""
    future = F.concat(F.array("anchor"), F.col("future"))
    move = lambda i: (future[i] - future[i - 1]) * F.col("ratio")
    deltas = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: clip(move(i), -limit, limit) if steps <= SHORT_STEPS else move(i))
    d = d.withColumn("__d", deltas)
    running = F.aggregate("__d", F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.col("last_price")) + x)))
    d = d.withColumn("path", running).drop("__d")
    return d.withColumn("returns", F.transform("path", lambda x: x / (F.col("last_price") + features.EPS)))


def history_tracks(paths: DataFrame) -> DataFrame:
    """(symbol, q_trading_date, tracks): rank, similarity, corr, start time, path (2 digits) and step returns of every match."""
    step = F.transform("returns", lambda r, i: r - F.when(i == 0, F.lit(1.0)).otherwise(F.get("returns", i - 1)))
    row = F.struct("rank", "similarity", F.round("corr", 4).alias("corr"), F.col("h_start_ts").alias("start_time"), F.transform("path", lambda x: rounded(x, 2)).alias("path"), step.alias("step_returns"), "low_confidence")
    return paths.groupBy(*KEY).agg(F.sort_array(F.collect_list(row)).alias("tracks"))


def mean_aligned_track(matches: DataFrame, bars: DataFrame, queries: DataFrame, n: int, steps: int = config.FUTURE_STEPS) -> DataFrame:
    """(symbol, q_trading_date, step, price): the best match's bars and what followed, shifted to the mean of today's."""
    d = placed(bars).select("symbol", "pos", "close", "closes")
    best = matches.where("rank = 1").select(*KEY, F.col("h_start_pos"))

    def mean(starts: DataFrame, name: str) -> DataFrame:
        ends = starts.select(*KEY, F.explode(F.array(F.col("start"), F.col("start") + n - 1)).alias("pos")).join(d, ["symbol", "pos"])
        first = F.min_by("close", "pos") - F.min_by("closes", "pos")
        return ends.groupBy(*KEY).agg(((F.max_by("closes", "pos") + first) / n).alias(name))

    shift = mean(best.select(*KEY, F.col("h_start_pos").alias("start")), "__h").join(mean(queries.select(*KEY, (F.col("last_pos") - n + 1).alias("start")), "__t"), list(KEY))
    span = best.select(*KEY, F.posexplode(F.sequence(F.col("h_start_pos"), F.col("h_start_pos") + n - 1 + steps)).alias("step", "pos")).join(d, ["symbol", "pos"])
    return span.join(shift, list(KEY)).select(*KEY, "step", rounded(F.col("close") - F.col("__h") + F.col("__t"), 2).alias("price"))


def ensemble_path(paths: DataFrame, steps: int = config.FUTURE_STEPS, factor: Column | None = None, drift: float = config.INST_DRIFT) -> DataFrame:
    """(symbol, q_trading_date, step, matcher): weighted sum of the paths; long horizons drift with the institution factor."""
    long = paths.select(*KEY, "weight", F.posexplode("path").alias("k", "price"))
    d = long.groupBy(*KEY, (F.col("k") + 1).alias("step")).agg(F.sum(F.col("weight") * F.col("price")).alias("matcher"))
    if steps > SHORT_STEPS and factor is not None:
        d = d.withColumn("matcher", F.col("matcher") + factor * drift * F.sqrt("step"))
    return d


def blend_weight(win_rate: Column, mse: Column, regime: Column, score: Column, mean_sim: Column) -> Column:
    """Share of the model in the forecast."""
    wins = clip((win_rate - 50) / 40, 0.0, 1.0)
    quality = F.when(mse > 0, clip(1 - mse / config.MSE_BASE, 0.0, 1.0)).otherwise(0.5)
    perf = 0.7 * wins + 0.3 * quality
    share = F.when(regime == "TRENDING", clip(0.30 + 0.55 * perf + 0.20 * score, 0.25, 0.85)).otherwise(clip(0.15 + 0.45 * perf, 0.15, 0.55))
    return F.when(mean_sim >= 92, F.least(share, F.lit(0.65))).otherwise(share)


def blend_path(d: DataFrame, steps: int = config.FUTURE_STEPS) -> DataFrame:
    """Adds predicted from matcher, model (may be null), share and, for short horizons, step_bias; for long ones the
    extrema biases and the recent velocity on the first three steps."""
    model = F.when(F.col("model").isNull(), F.col("matcher")).otherwise((1 - F.col("share")) * F.col("matcher") + F.col("share") * F.col("model"))
    if steps <= SHORT_STEPS:
        return d.withColumn("predicted", model - F.coalesce("step_bias", F.lit(0.0)))
    limit = F.col("last_price") * 0.003
    shift = clip((F.col("high_bias") + F.col("low_bias")) / 2, -limit, limit)
    push = F.when(F.col("step") == 1, 0.5).when(F.col("step") == 2, 0.25).when(F.col("step") == 3, 0.1).otherwise(0.0)
    return d.withColumn("predicted", model + shift + F.col("velocity") * push)


def confidence_band(predicted: DataFrame, paths: DataFrame, k: Column) -> DataFrame:
    """Adds upper and lower: predicted * (1 +- k * 1.5 * sqrt(step) * max(spread of the paths, recent volatility))."""
    spread = paths.select(*KEY, F.posexplode("returns").alias("i", "r")).groupBy(*KEY, (F.col("i") + 1).alias("step")).agg(F.stddev_pop("r").alias("__s"))
    base = F.coalesce(F.col("vol30") / (F.col("last_price") + features.EPS), F.lit(0.0008))
    d = predicted.join(spread, [*KEY, "step"]).withColumn("__e", F.greatest("__s", base) * F.sqrt("step") * 1.5)
    return d.withColumns({"upper": F.col("predicted") * (1 + k * F.col("__e")), "lower": F.col("predicted") * (1 - k * F.col("__e"))}).drop("__s", "__e")


def quantile_band(predicted: DataFrame, tracks: DataFrame, k: Column, high_bias: Column, low_bias: Column) -> DataFrame:
    """Adds q_upper and q_lower from the 10th and 90th percentile of the tracks at each step, at least 0.05 away.

    Without tracks: max(0.3, deviation of the forecast * k) either way.
    """
    at = tracks.select(*KEY, F.posexplode("path").alias("i", "p")).groupBy(*KEY, (F.col("i") + 1).alias("step")).agg(F.percentile("p", F.lit(0.1)).alias("__lo"), F.percentile("p", F.lit(0.9)).alias("__hi"))
    p = F.col("predicted")
    d = predicted.join(at, [*KEY, "step"], "left")
    w = W.partitionBy(*KEY)
    half = F.greatest(F.lit(0.3), F.when(F.count("*").over(w) > 1, F.stddev_pop("predicted").over(w)).otherwise(0.5) * k)
    low = F.least(p + (F.col("__lo") - p) * k + low_bias, p - 0.05)
    high = F.greatest(p + (F.col("__hi") - p) * k + high_bias, p + 0.05)
    none = F.col("__lo").isNull()
    return d.withColumns({"q_lower": rounded(F.when(none, p - half).otherwise(low), 2), "q_upper": rounded(F.when(none, p + half).otherwise(high), 2)}).drop("__lo", "__hi")


def rest_of_day_extrema(paths: DataFrame, predicted: DataFrame, state: DataFrame, min_span: float = 1.80, span: float = 2.20) -> DataFrame:
    """(symbol, q_trading_date, rest_high, rest_low, high_step, low_step).

    ``state``: (symbol, q_trading_date, last_price, base, inst_factor, high_bias, low_bias); base is the Kalman level.
    """
    path = paths.select(*KEY, "weight", F.posexplode("returns").alias("i", "r")).groupBy(*KEY, "i").agg(F.sum(F.col("weight") * F.col("r")).alias("r"))
    ends = path.groupBy(*KEY).agg((F.max("r") - 1).alias("__up"), (F.min("r") - 1).alias("__down"))
    level = F.round("predicted", 9)  # equal levels count as equal: the first step stands
    steps = predicted.groupBy(*KEY).agg(F.min_by("step", F.struct(-level, F.col("step"))).alias("high_step"), F.min_by("step", F.struct(level, F.col("step"))).alias("low_step"))
    d = ends.join(steps, list(KEY)).join(state, list(KEY))
    limit = F.col("last_price") * 0.005
    high = F.col("base") * (1 + F.greatest("__up", F.lit(0.0008))) + F.greatest(F.lit(0.0), F.col("inst_factor") * 0.25) + clip(F.col("high_bias"), -limit, limit)
    low = F.col("base") * (1 + F.least("__down", F.lit(-0.0015))) + F.least(F.lit(0.0), F.col("inst_factor") * 0.25) + clip(F.col("low_bias"), -limit, limit)
    d = d.withColumns({"rest_high": high, "__low": low})
    d = d.withColumn("rest_low", F.when(F.col("rest_high") - F.col("__low") < min_span, F.col("rest_high") - span).otherwise(F.col("__low")))
    return d.select(*KEY, "rest_high", "rest_low", "high_step", "low_step")


def extrema_time_label(step: Column, as_of: Column) -> Column:
    """now (3 steps or less), or the clock time with minutes, or hours and minutes, ahead."""
    clock = F.date_format(as_of + F.make_interval(mins=step), "HH:mm")
    hours = F.format_string("%s (in %dh%02dm)", clock, F.floor(step / 60), step % 60)
    return F.when(step <= 3, F.lit("now")).when(step >= 60, hours).otherwise(F.format_string("%s (in %dm)", clock, step))


def direction_votes(paths: DataFrame, threshold: float = config.VOTE_THRESHOLD) -> DataFrame:
    """(symbol, q_trading_date, up/down/flat votes and weights, mean_sim): a match votes where its end is beyond the
    threshold and its mean has the same sign."""
    end, mean = F.element_at("returns", -1) - 1, F.aggregate("returns", F.lit(0.0), lambda a, x: a + x - 1) / F.size("returns")
    side = F.when((end > threshold) & (mean > 0), "up").when((end < -threshold) & (mean < 0), "down").otherwise("flat")
    d = paths.withColumn("__v", side)
    counts = [F.count_if(F.col("__v") == v).alias(f"{v}_votes") for v in ("up", "down", "flat")]
    weights = [F.sum(F.when(F.col("__v") == v, F.col("weight")).otherwise(0.0)).alias(f"{v}_weight") for v in ("up", "down", "flat")]
    return d.groupBy(*KEY).agg(*counts, *weights, F.avg("similarity").alias("mean_sim"))


def direction_confidence(votes: DataFrame, win_rate: Column, resonance: Column) -> DataFrame:
    """Adds confidence (3 digits) and label: bull, bear or mixed; resonance of three horizons overrides both."""
    most = F.greatest("up_weight", "down_weight", "flat_weight")
    raw = rounded(0.50 * most + 0.35 * F.col("mean_sim") / 100 + 0.15 * clip(win_rate / 100, 0.4, 1.0), 3)
    label = F.when((most == F.col("up_weight")) & (F.col("__c") >= 0.55), "bull").when((most == F.col("down_weight")) & (F.col("__c") >= 0.55), "bear").otherwise("mixed")
    d = votes.withColumn("__c", raw).withColumn("__l", label)
    strong = resonance != 0
    both = {"confidence": F.when(strong, clip(F.col("__c") + 0.20, 0.85, 0.98)).otherwise(F.col("__c")), "label": F.when(resonance > 0, "bull resonance").when(resonance < 0, "bear resonance").otherwise(F.col("__l"))}
    return d.withColumns(both).drop("__c", "__l")


def channel_position(d: DataFrame, min_span: float = 1.8) -> DataFrame:
    """Adds position (0 at the expected low, 1 at the high), upside, downside and reward_risk (2 digits)."""
    span = F.greatest(F.col("rest_high") - F.col("rest_low"), F.lit(min_span))
    up, down = F.greatest(F.lit(0.0), F.col("rest_high") - F.col("last_price")), F.greatest(F.lit(0.0), F.col("last_price") - F.col("rest_low"))
    return d.withColumns({"position": clip((F.col("last_price") - F.col("rest_low")) / span, 0.0, 1.0), "upside": up, "downside": down, "reward_risk": rounded(up / F.greatest(down, F.lit(0.05)), 2)})


def raw_advice(d: DataFrame) -> DataFrame:
    """Adds advice_raw from position, slope_15, label, delta (forecast's end less price), top1_sim, top1_delta, confidence,
    high_step and upside, before any memory of earlier advice.

    First the trend rules, then the guards around an expected peak, then the least profits.
    """
    pos, slope, delta, peak, up = (F.col(c) for c in ("position", "slope_15", "delta", "high_step", "upside"))
    bull, bear = F.col("label").isin("bull", "bull resonance"), F.col("label").isin("bear", "bear resonance")
    rising = (slope >= 0.15) | bull
    falling = ~rising & ((slope < -0.15) | (delta < -0.25) | bear)
    similar = (F.col("top1_sim") >= 80) & (F.col("top1_delta") > 0.40) & (pos <= 0.85)
    first = (
        F.when(falling, F.when(pos >= 0.75, "STRONG_SELL").when(pos >= 0.40, "SELL_RISK").otherwise("WAIT"))
        .when(rising, F.when(pos <= 0.50, "STRONG_BUY").when(pos <= 0.85, "BUY_DIP").otherwise("WAIT"))
        .when(similar, F.when((pos <= 0.40) | (F.col("confidence") >= 0.70), "STRONG_BUY").otherwise("BUY_DIP"))
        .when((pos <= 0.35) & ((delta >= 0.05) | bull), F.when(pos <= 0.20, "STRONG_BUY").otherwise("BUY_DIP"))
        .when((pos > 0.35) & (pos <= 0.75) & (delta >= 0.05), "BUY_DIP")
        .when((pos > 0.85) & (delta < -0.10) & (slope <= 0), "SELL_RISK")
        .otherwise("WAIT")
    )
    d = d.withColumn("__a", first)
    a = F.col("__a")
    sells = a.isin("SELL_RISK", "STRONG_SELL")
    guarded = (
        F.when(rising | (slope > 0.10), F.when(sells, F.when(pos <= 0.85, "BUY_DIP").otherwise("WAIT")).otherwise(a))
        .when(peak.between(5, 15) & (pos >= 0.75) & (slope <= 0.05), F.when(a.isin("BUY_DIP", "WAIT"), "SELL_RISK").otherwise(a))
        .when((peak <= 5) & (pos >= 0.85) & (delta < 0) & (slope < 0), "STRONG_SELL")
        .otherwise(a)
    )
    d = d.withColumn("__a", guarded)
    d = d.withColumn("__a", F.when((up < 3.00) & (a == "STRONG_BUY"), "BUY_DIP").otherwise(a))
    return d.withColumn("advice_raw", F.when((up < 1.20) & (a == "BUY_DIP"), "WAIT").otherwise(a)).drop("__a")


def next_advice(last: str, raw: str, upside: float, position: float, peak: float) -> str:
    """One step of the advice memory: a long side is held while profit is left, and no direct flip between the extremes."""
    if last in ("STRONG_BUY", "BUY_DIP") and upside >= 2.50 and position <= 0.85 and peak > 15 and raw in ("SELL_RISK", "STRONG_SELL"):
        raw = "BUY_DIP"
    return "WAIT" if {last, raw} == {"STRONG_BUY", "STRONG_SELL"} else raw


ADVICE = ("STRONG_BUY", "BUY_DIP", "WAIT", "SELL_RISK", "STRONG_SELL")


def advice_state(d: DataFrame, by: tuple[str, ...] = ("symbol",), order: str = "q_trading_date", chunk: int = 4096) -> DataFrame:
    """Adds advice: the raw advice of each series passed through the memory in order, starting from WAIT.

    A row maps each possible last advice to the next one; a chunk's rows are composed to one such map, ``carried`` says
    what each chunk starts from, and each chunk is expanded from there.
    """
    d = with_position(d, by, order).withColumn("__chunk", F.floor(F.col("pos") / chunk).cast("long"))
    keys, inputs = [*by, "__chunk"], ["advice_raw", "upside", "position", "high_step"]

    def run(rows: pd.DataFrame, last: str) -> list[str]:
        out = []
        for raw, up, pos, peak in rows.sort_values("pos")[inputs].itertuples(index=False):
            last = next_advice(last, raw, up, pos, peak)
            out.append(last)
        return out

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.iloc[:1][keys].assign(ends=[[run(rows, a)[-1] for a in ADVICE]])

    def expand(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        return rows.assign(advice=run(rows, rows["__start"].iloc[0])).drop(columns=["__chunk", "__start", "pos"])

    maps = d.groupBy(*keys).applyInPandas(compose, d.select(*keys).withColumn("ends", F.array(F.lit(""))).schema)
    names = F.array(*[F.lit(a) for a in ADVICE])
    leads = lambda last, ends: F.element_at(ends, F.array_position(names, last).cast("int"))
    starts = carried(maps, "ends", lambda s, e: F.transform(s, lambda last: leads(last, e)), leads, F.lit("WAIT"), by)
    started = d.join(starts.withColumnRenamed("__x", "__start"), keys)
    schema = started.drop("__chunk", "__start", "pos").withColumn("advice", F.lit("")).schema
    return started.groupBy(*keys).applyInPandas(expand, schema)


def advice_record(d: DataFrame, n: int) -> DataFrame:
    """Adds record: action, time window, expected profit, targets and reward_risk as a struct."""
    span = "30 to 60 minutes" if n < 60 else "45 to 90 minutes" if n < 180 else "rest of the session"
    text = {"STRONG_BUY": "buy", "BUY_DIP": "buy dips", "SELL_RISK": "reduce", "STRONG_SELL": "sell", "WAIT": "wait"}
    a = F.col("advice")
    action = F.coalesce(*[F.when(a == k, v) for k, v in text.items()])
    money = lambda sign, c: F.format_string(sign + "%.2f", c)
    profit = F.when(a.isin("STRONG_BUY", "BUY_DIP"), money("+", F.col("upside"))).when(a == "WAIT", money("+-", F.greatest("upside", "downside"))).otherwise(money("-", F.col("downside")))
    fields = [action.alias("action"), a.alias("advice_type"), F.lit(span).alias("time_window"), profit.alias("expected_profit"), *[rounded(c, 2).alias(c) for c in ("upside", "downside", "rest_high", "rest_low")], "reward_risk"]
    return d.withColumn("record", F.struct(*fields))


#: What the evaluation of earlier forecasts feeds back, and its values for a series without any.
FEEDBACK = {"win_rate": 100.0, "k": 1.0, "mse": 0.0, "inst_factor": 0.0, "high_bias": 0.0, "low_bias": 0.0}


def with_feedback(d: DataFrame, feedback: DataFrame | None) -> DataFrame:
    """Adds the columns of FEEDBACK and step_biases (array) by symbol, or by (symbol, q_trading_date) if ``feedback`` has
    both; what isn't given has its default."""
    have = set(feedback.columns) if feedback is not None else set()
    if feedback is not None:
        by = [c for c in KEY if c in have]
        d = d.join(feedback.select(*by, *[F.col(c).alias(f"__{c}") for c in (*FEEDBACK, "step_biases") if c in have]), by, "left")
    value = lambda c, none: F.coalesce(f"__{c}", none) if c in have else none
    none = F.array().cast("array<double>")
    d = d.withColumns({c: value(c, F.lit(v)) for c, v in FEEDBACK.items()} | {"step_biases": value("step_biases", none)})
    return d.drop(*[f"__{c}" for c in have])


def model_path(said: DataFrame, queries: DataFrame, steps: int = config.FUTURE_STEPS) -> DataFrame:
    """(symbol, q_trading_date, step, model): returns compounded from each query's price; the last one stands for the rest."""
    prices = F.aggregate("returns", F.array().cast("array<double>"), lambda a, r: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.col("last_price")) * (1 + r))))
    d = said.where("returns is not null").select(*KEY, "returns").join(queries.select(*KEY, "last_price"), list(KEY)).select(*KEY, prices.alias("p"))
    path = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.get("p", F.least(i, F.size("p") - 1)))
    return d.select(*KEY, F.posexplode(path).alias("step", "model")).withColumn("step", F.col("step") + 1)


def generate_forecast(bars: DataFrame, windows: DataFrame, matches: DataFrame, n: int, steps: int = config.FUTURE_STEPS, feedback: DataFrame | None = None, model: DataFrame | None = None, minutes: int = 1) -> DataFrame:
    """One forecast for every query of ``windows``; those without a match get a default record.

    Columns: last_price, predicted, upper, lower, q_upper, q_lower (arrays, 2 digits), valid_count, votes, confidence,
    label, rest_high, rest_low, steps and time labels of both, regime, position, advice_raw, advice, record, tracks and
    top1_track.  ``feedback``: one row a symbol or a query, see ``with_feedback``; biases are taken off, the win rate and the
    error weigh the model, k widens the bands.  ``model``: (symbol, q_trading_date, step, model).  A bar is ``minutes`` long.
    """
    bars = settled(placed(bars), "placed")
    queries = settled(query_prices(bars, windows, n), "queries")
    paths = settled(project_path(vol_ratio(match_future(softmax_weights(matches), bars, n, steps), bars, queries, n), steps), "paths")
    at_bar = features.apply(bars, features.market_regime(), features.kalman_level(), features.resonance(), features.short_slopes(), behind=30, positioned=True)
    at_bar = at_bar.select("symbol", F.col("pos").alias("last_pos"), "regime", "regime_score", F.col("kalman").alias("base"), "resonance", "slope_15")
    per_query = settled(with_feedback(queries.join(at_bar, ["symbol", "last_pos"]), feedback).join(direction_votes(paths), list(KEY)), "votes")
    per_query = per_query.withColumn("share", blend_weight(F.col("win_rate"), F.col("mse"), F.col("regime"), F.col("regime_score"), F.col("mean_sim")))
    steps_df = ensemble_path(paths, steps)
    steps_df = steps_df.join(model, [*KEY, "step"], "left") if model is not None else steps_df.withColumn("model", F.lit(None).cast("double"))
    told = per_query.select(*KEY, "share", "last_price", "vol30", "velocity", "k", "inst_factor", "high_bias", "low_bias", "step_biases")
    bias = F.get("step_biases", F.least(F.col("step"), F.size("step_biases")) - 1)  # the last one goes on
    steps_df = steps_df.join(told, list(KEY)).withColumn("step_bias", F.coalesce(bias, F.lit(0.0)))
    if steps > SHORT_STEPS:
        steps_df = steps_df.withColumn("matcher", F.col("matcher") + F.col("inst_factor") * config.INST_DRIFT * F.sqrt("step"))
    predicted = confidence_band(blend_path(steps_df, steps), paths, F.col("k"))
    predicted = settled(quantile_band(predicted, paths, F.col("k"), F.col("high_bias"), F.col("low_bias")), "predicted")
    extrema = rest_of_day_extrema(paths, predicted, per_query.select(*KEY, "last_price", "base", "inst_factor", "high_bias", "low_bias"))
    bands = ("predicted", "upper", "lower", "q_upper", "q_lower")
    arrays = predicted.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("step", *bands))).alias("__s"))
    two = lambda c: F.transform("__s", lambda x: rounded(x[c], 2)).alias(c)
    arrays = arrays.select(*KEY, *[two(c) for c in bands], F.element_at("__s", -1)["predicted"].alias("__end"))
    top1 = mean_aligned_track(matches, bars, queries, n, steps).groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "price"))), lambda x: x["price"]).alias("top1_track"))
    best = matches.where("rank = 1").select(*KEY, F.col("similarity").alias("top1_sim"))
    d = per_query.join(extrema, list(KEY)).join(arrays, list(KEY)).join(best, list(KEY)).join(top1, list(KEY), "left").join(history_tracks(paths), list(KEY), "left")
    track = F.col("top1_track")
    d = d.withColumns({"top1_delta": F.when(F.size(track) >= 10, F.element_at(track, -1) - track[0]).otherwise(0.0), "delta": F.col("__end") - F.col("last_price"), "valid_count": F.col("up_votes") + F.col("down_votes") + F.col("flat_votes")})
    d = d.withColumns({f"{c}_time": extrema_time_label(F.col(f"{c}_step") * minutes, F.col("as_of")) for c in ("high", "low")})
    d = settled(direction_confidence(d, F.col("win_rate"), F.col("resonance")), "forecasts")
    d = advice_record(advice_state(settled(raw_advice(channel_position(d)).drop("__end"), "advice")), n)
    out = ["valid_count", "up_votes", "down_votes", "flat_votes", "confidence", "label", *bands, "rest_high", "rest_low", "high_step", "low_step", "high_time", "low_time", "regime", "position", "advice_raw", "advice", "record", "tracks", "top1_track"]
    full = queries.select(*KEY, "last_price").join(d.select(*KEY, *out), list(KEY), "left")
    return full.withColumns({"valid_count": F.coalesce("valid_count", F.lit(0)), "confidence": F.coalesce("confidence", F.lit(0.0)), "label": F.coalesce("label", F.lit("no data")), "advice": F.coalesce("advice", F.lit("NEUTRAL"))})
