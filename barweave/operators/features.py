"""Smoothing and technical features of every bar, from a bounded number of bars before it.

Every function takes a bar table and adds columns.  Windows run over chunks with a halo of the longest look-back, so
one long series is many tasks; ``all_features`` shares one shuffle between all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barweave import config
from barweave.functions.columns import clip, rounded
from barweave.functions.windows import decay_chunk, decayed_sum, in_chunks
from barweave.operators import cleaning

EPS = 1e-8
KERNEL = (0.1, 0.2, 0.4, 0.2, 0.1)
#: Name, mean and spread of each feature, in the order of the vector (fixed values).
FEATURES = (
    ("rsi", 0.0, 0.5),
    ("ema_dist", 0.0, 0.15),
    ("atr", 0.05, 0.04),
    ("mom3", 0.0, 0.08),
    ("mom6", 0.0, 0.12),
    ("slope15", 0.0, 0.15),
    ("vol_imb", 0.0, 0.5),
    ("inst", 0.0, 0.5),
    ("hist_sim", 0.70, 0.15),
    ("hist_consensus", 0.0, 0.5),
    ("hist_return", 0.0, 0.10),
    ("vwap_bias", 0.0, 0.10),
    ("obv_slope", 0.0, 0.5),
    ("vol5", 0.02, 0.02),
    ("vol15", 0.05, 0.03),
    ("range60", 0.50, 0.25),
    ("mom_accel", 0.0, 0.10),
    ("dxy", 0.0, 0.5),
    ("us10y", 0.0, 0.5),
    ("macro", 0.0, 0.5),
)

Step = Callable[[DataFrame, W], DataFrame]


def _last(w: W, n: int) -> W:
    return w.rowsBetween(1 - n, 0)


def _change(w: W, lag: int = 1, col: str = "close") -> Column:
    return F.col(col) - F.lag(col, lag).over(w)


def _percent(w: W, lag: int) -> Column:
    before = F.lag("close", lag).over(w)
    return F.coalesce((F.col("close") - before) / (before + EPS) * 100, F.lit(0.0))


def apply(df: DataFrame, *steps: Step, behind: int = 60, ahead: int = 0, chunk: int = 4096, positioned: bool = False) -> DataFrame:
    """The steps in one pass over chunks; a ``positioned`` frame has ``pos`` and keeps it."""

    def run(d: DataFrame, w: W) -> DataFrame:
        for step in steps:
            d = step(d, w)
        return d

    d = in_chunks(df, run, behind, ahead, chunk=chunk, positioned=positioned)
    return d if positioned else d.drop("pos")


def skeleton(bars: DataFrame, width: str = "5 minutes", kernel: Sequence[float] = KERNEL, gap: float = 5 * config.GAP_MINUTES) -> DataFrame:
    """Wider bars with ``close_smooth`` (2 digits; the first and last half kernel raw), time_diff and is_gap."""
    half = len(kernel) // 2

    def smooth(d: DataFrame, w: W) -> DataFrame:
        taps = [(F.lag("close", half - k) if k < half else F.lead("close", k - half) if k > half else F.col("close")) for k in range(len(kernel))]
        taps = [t.over(w) if k != half else t for k, t in enumerate(taps)]
        total = sum((t * x for t, x in zip(taps[1:], kernel[1:], strict=True)), taps[0] * kernel[0])
        return d.withColumn("close_smooth", rounded(F.coalesce(total, F.col("close")), 2))

    return cleaning.flag_gaps(apply(cleaning.resample_bars(bars, width), smooth, behind=half, ahead=half), gap)


def smooth_boxcar(df: DataFrame, k: int = 5) -> DataFrame:
    """Adds ``smooth``: the centred mean of k closes; k // 2 values at either end are raw."""
    half = k // 2

    def smooth(d: DataFrame, w: W) -> DataFrame:
        frame = w.rowsBetween(-half, half)
        return d.withColumn("smooth", F.when(F.count("*").over(frame) == 2 * half + 1, F.avg("close").over(frame)).otherwise(F.col("close")))

    return apply(df, smooth, behind=half, ahead=half) if k > 1 else df.withColumn("smooth", F.col("close"))


def rsi(n: int = 14) -> Step:
    """rsi: 100 - 100 / (1 + mean gain / mean loss) of n differences, the first one counted as 0; 50 before n rows."""

    def step(d: DataFrame, w: W) -> DataFrame:
        diff = F.coalesce(_change(w), F.lit(0.0))
        d = d.withColumns({"__gain": F.greatest(diff, F.lit(0.0)), "__loss": F.greatest(-diff, F.lit(0.0))})
        value = 100 - 100 / (1 + F.avg("__gain").over(_last(w, n)) / (F.avg("__loss").over(_last(w, n)) + EPS))
        return d.withColumn("rsi", F.when(F.col("pos") >= n - 1, value).otherwise(50.0)).drop("__gain", "__loss")

    return step


def ewm(df: DataFrame, span: int = 20) -> DataFrame:
    """Adds ema (exponentially weighted mean with weights normalized over the rows so far) and ema_dist in percent."""
    keep = 1 - 2 / (span + 1)
    halo, chunk = decay_chunk(keep)

    def step(d: DataFrame, w: W) -> DataFrame:
        age = F.col("pos") - F.min("pos").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        d = d.withColumn("__age", age)
        ema = decayed_sum(F.col("close"), keep, w, F.col("__age")) / decayed_sum(F.lit(1.0), keep, w, F.col("__age"))
        return d.withColumn("ema", ema).withColumn("ema_dist", (F.col("close") - F.col("ema")) / (F.col("ema") + EPS) * 100).drop("__age")

    return apply(df, step, behind=halo, chunk=chunk)


def atr_pct(n: int = 14) -> Step:
    def step(d: DataFrame, w: W) -> DataFrame:
        d = d.withColumn("__tr", F.greatest(F.col("high") - F.col("low"), F.lit(1e-4)))
        return d.withColumn("atr", F.avg("__tr").over(_last(w, n)) / (F.col("close") + EPS) * 100).drop("__tr")

    return step


def momentum(lags: tuple[int, int, int] = (3, 6, 14)) -> Step:
    """mom3, mom6, slope15 in percent (0 where history is short) and mom_accel = mom3 - mom6."""

    def step(d: DataFrame, w: W) -> DataFrame:
        d = d.withColumns(dict(zip(("mom3", "mom6", "slope15"), (_percent(w, k) for k in lags), strict=True)))
        return d.withColumn("mom_accel", F.col("mom3") - F.col("mom6"))

    return step


def volume_direction(n: int = 14) -> Step:
    """vol_imb: (volume of rising bars - of falling ones) over their sum, n differences."""

    def step(d: DataFrame, w: W) -> DataFrame:
        diff = _change(w)
        d = d.withColumns({"__up": F.when(diff > 0, F.col("volume")).otherwise(0.0), "__down": F.when(diff < 0, F.col("volume")).otherwise(0.0)})
        up, down = F.sum("__up").over(_last(w, n)), F.sum("__down").over(_last(w, n))
        return d.withColumn("vol_imb", (up - down) / (up + down + EPS)).drop("__up", "__down")

    return step


def vwap_dev(n: int = 20) -> Step:
    def step(d: DataFrame, w: W) -> DataFrame:
        f = _last(w, n)
        d = d.withColumn("__pv", F.col("close") * F.col("volume"))
        d = d.withColumn("vwap", F.sum("__pv").over(f) / (F.sum("volume").over(f) + EPS))
        return d.withColumn("vwap_bias", (F.col("close") - F.col("vwap")) / (F.col("vwap") + EPS) * 100).drop("__pv")

    return step


def obv_slope(n: int = 9) -> Step:
    """obv_slope: mean of signed volume over mean volume; a series' first bar has no sign and doesn't count."""

    def step(d: DataFrame, w: W) -> DataFrame:
        f = _last(w, n)
        d = d.withColumn("__sv", F.signum(_change(w)) * F.col("volume"))
        return d.withColumn("obv_slope", F.coalesce(F.avg("__sv").over(f), F.lit(0.0)) / (F.avg("volume").over(f) + EPS)).drop("__sv")

    return step


def vol_cluster(sizes: tuple[int, int] = (4, 14)) -> Step:
    """vol5 and vol15: population deviation of simple returns."""

    def step(d: DataFrame, w: W) -> DataFrame:
        d = d.withColumn("__r", _change(w) / (F.lag("close").over(w) + EPS))
        return d.withColumns({n: F.coalesce(F.stddev_pop("__r").over(_last(w, k)), F.lit(0.0)) for n, k in zip(("vol5", "vol15"), sizes, strict=True)}).drop("__r")

    return step


def range_position(n: int = 60) -> Step:
    def step(d: DataFrame, w: W) -> DataFrame:
        low, high = F.min("close").over(_last(w, n)), F.max("close").over(_last(w, n))
        return d.withColumn("range60", (F.col("close") - low) / (high - low + EPS))

    return step


def volume_imbalance(n: int = 30, has_open: bool = True) -> Step:
    """imbalance in -1..1, 3 digits: signed candle body (or close difference) times volume; 0 before 5 rows."""

    def step(d: DataFrame, w: W) -> DataFrame:
        body = F.col("close") - F.col("open") if has_open else F.when(F.row_number().over(w) > 1, _change(w)).otherwise(0.0)
        d = d.withColumn("__flow", body * F.coalesce("volume", F.lit(1.0)))
        f = _last(w, n)
        buy, sell = F.sum(F.greatest("__flow", F.lit(0.0))).over(f), F.sum(F.greatest(-F.col("__flow"), F.lit(0.0))).over(f)
        value = rounded(clip((buy - sell) / (buy + sell + EPS), -1.0, 1.0), 3)
        return d.withColumn("imbalance", F.when(F.col("pos") >= 4, value).otherwise(0.0)).drop("__flow")

    return step


def market_regime(n: int = 30) -> Step:
    """regime_score (volatility of n - 1 returns and change over them, 0..1) and regime; RANGING, 0.5 before n rows."""

    def step(d: DataFrame, w: W) -> DataFrame:
        d = d.withColumn("__r", _change(w) / (F.lag("close").over(w) + EPS))
        first = F.lag("close", n - 1).over(w)
        raw = F.stddev_pop("__r").over(_last(w, n - 1)) * 1200 + F.abs((F.col("close") - first) / (first + EPS)) * 250
        d = d.withColumn("regime_score", F.when(F.col("pos") >= n - 1, clip(raw, 0.0, 1.0)).otherwise(0.5))
        trending = (F.col("pos") >= n - 1) & (F.col("regime_score") > 0.45)
        return d.withColumn("regime", F.when(trending, "TRENDING").otherwise("RANGING")).drop("__r")

    return step


def kalman_weights(n: int, q: float = 1e-4, r: float = 1e-2) -> list[float]:
    """Weights, newest value first, of a scalar Kalman filter started at the oldest of n values."""
    weights, variance = [0.0] * n, 1.0
    weights[0] = 1.0
    for k in range(n):
        variance += q
        gain = variance / (variance + r)
        weights = [x * (1 - gain) for x in weights]
        weights[k] += gain
        variance *= 1 - gain
    return weights[::-1]


def kalman_level(n: int = 15, q: float = 1e-4, r: float = 1e-2) -> Step:
    """kalman: gains don't depend on the data, so the estimate of the last n closes is a fixed weighted sum."""

    def step(d: DataFrame, w: W) -> DataFrame:
        value = F.col("close")  # before 5 rows
        by_rows = {}
        for m in range(5, n + 1):
            terms = [(F.lag("close", k).over(w) if k else F.col("close")) * x for k, x in enumerate(kalman_weights(m, q, r))]
            by_rows[m] = sum(terms[1:], terms[0])
        chain = F.when(F.col("pos") >= n - 1, by_rows[n])
        for m in range(5, n):
            chain = chain.when(F.col("pos") == m - 1, by_rows[m])
        return d.withColumn("kalman", chain.otherwise(value))

    return step


def recent_abs_move(n: int = 30, default: float = 0.20) -> Step:
    """abs_move: mean absolute difference inside the last n closes; the default before 5 rows."""

    def step(d: DataFrame, w: W) -> DataFrame:
        d = d.withColumn("__d", F.abs(_change(w)))
        return d.withColumn("abs_move", F.when(F.col("pos") >= 4, F.avg("__d").over(_last(w, n - 1))).otherwise(default)).drop("__d")

    return step


def resonance(lags: tuple[int, int, int] = (2, 9, 29)) -> Step:
    """resonance: 1 or -1 where the changes over all lags have that sign, else 0."""

    def step(d: DataFrame, w: W) -> DataFrame:
        a, b, c = (F.signum(_change(w, k)) for k in lags)
        return d.withColumn("resonance", F.coalesce(F.when((a == b) & (b == c), a), F.lit(0.0)).cast("int"))

    return step


def short_slopes(lags: tuple[int, int] = (14, 4)) -> Step:
    """slope_15 and slope_5: change in price, 0 where history is short."""

    def step(d: DataFrame, w: W) -> DataFrame:
        return d.withColumns({name: F.coalesce(_change(w, k), F.lit(0.0)) for name, k in zip(("slope_15", "slope_5"), lags, strict=True)})

    return step


def trend_bias(daily: DataFrame, n: int = 5, gain: float = 200.0, order: str = "day") -> DataFrame:
    """(symbol, bias): slope of the last n closes over the first of them, times gain, in -1..1; 0 under 2 rows."""
    rank = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc(order)))
    last = daily.withColumn("__k", rank).where(F.col("__k") <= n)
    slope = F.regr_slope("close", -F.col("__k").cast("double"))
    first = F.max_by("close", "__k")
    return last.groupBy("symbol").agg(F.when(F.count("*") >= 2, clip(slope / first * gain, -1.0, 1.0)).otherwise(0.0).alias("bias"))


def institution_factor(holdings: Column, imbalance: Column) -> Column:
    return clip(0.6 * holdings + 0.4 * imbalance, -1.0, 1.0)


def bar_features(df: DataFrame) -> DataFrame:
    """All features of a bar that need bars alone, with one shuffle for the frames and one for the decayed mean."""
    steps = (rsi(), atr_pct(), momentum(), volume_direction(), vwap_dev(), obv_slope(), vol_cluster(), range_position(), volume_imbalance(), market_regime(), kalman_level(), recent_abs_move(), resonance(), short_slopes())
    counted = lambda d, w: d.withColumn("n_bars", F.col("pos") + 1)
    return apply(ewm(df), *steps, counted, behind=60)


def match_features(tracks: DataFrame, last: DataFrame) -> DataFrame:
    """(symbol, bar_ts, hist_sim, hist_consensus, hist_return) of (symbol, bar_ts, similarity, path) rows, one for each match,
    and (symbol, bar_ts, close): mean similarity, share of rising less share of falling paths, and their mean move in percent."""
    end = F.when(F.size("path") > 0, F.element_at("path", -1) - F.col("path")[0])
    d = tracks.withColumn("__end", end).groupBy("symbol", "bar_ts").agg(
        F.avg(F.col("similarity") / 100).alias("hist_sim"),
        F.coalesce(F.avg(F.signum("__end")), F.lit(0.0)).alias("hist_consensus"),
        F.coalesce(F.avg("__end"), F.lit(0.0)).alias("__move"),
    )
    d = d.join(last.select("symbol", "bar_ts", "close"), ["symbol", "bar_ts"])
    return d.select("symbol", "bar_ts", "hist_sim", "hist_consensus", (F.col("__move") / (F.col("close") + EPS) * 100).alias("hist_return"))


def feature_vector(features: DataFrame, matches: DataFrame | None = None, biases: DataFrame | None = None) -> DataFrame:
    """(symbol, bar_ts, n_bars, features): 20 values, standardized by fixed constants and clipped to 3; zeros before 20 bars.

    ``matches``: (symbol, bar_ts, hist_sim, hist_consensus, hist_return); ``biases``: (symbol, inst, dxy, us10y).
    Without them their neutral values stand.
    """
    d = features
    if matches is not None:
        d = d.join(matches, ["symbol", "bar_ts"], "left")
    if biases is not None:
        d = d.join(biases, "symbol", "left")
    have = set(d.columns)
    value = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    dxy, us10y = clip(value("dxy", 0.0), -1.0, 1.0), clip(value("us10y", 0.0), -1.0, 1.0)
    raw = {
        "rsi": (F.col("rsi") - 50) / 50,
        "inst": clip(value("inst", 0.0), -1.0, 1.0),
        "hist_sim": value("hist_sim", 0.70),
        "hist_consensus": value("hist_consensus", 0.0),
        "hist_return": value("hist_return", 0.0),
        "dxy": dxy,
        "us10y": us10y,
        "macro": (F.abs(dxy) + F.abs(us10y)) / 2,
    }
    scaled = [clip((raw.get(n, F.col(n)) - m) / (s + EPS), -3.0, 3.0) for n, m, s in FEATURES]
    zeros = F.array(*[F.lit(0.0)] * len(FEATURES))
    return d.select("symbol", "bar_ts", "n_bars", F.when(F.col("n_bars") >= 20, F.array(*scaled)).otherwise(zeros).alias("features"))
