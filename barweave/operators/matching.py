"""Days that look alike: a similarity join of trading-day windows.

Every (symbol, trading day) is a query; candidates are the other days of its series.  Windows are z-scored once and
kept as one row each.  Queries are cut into blocks, windows into parts, and a task compares one block with one part as
a matrix product, keeping the best few of each query.  Nothing is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barweave import config
from barweave.functions.columns import clip
from barweave.functions.scratch import settled
from barweave.functions.windows import with_position
from barweave.operators import calendar

#: Queries in a block and windows in a part: what a task of the matrix form holds.
BLOCK, PART = 512, 2048
#: Pairs whose DTW is measured at once.
DTW_ROWS = 4096
LADDER = (4, 5.0, 50.0)


def z_normalize(windows: DataFrame, col: str = "closes") -> DataFrame:
    """Adds z: (x - mean) / population deviation; zeros for a flat window; and sd."""
    a = F.col(col)
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    d = windows.withColumn("__mean", mean)
    var = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - F.col("__mean")) * (x - F.col("__mean"))) / n
    d = d.withColumn("sd", F.sqrt(var))
    flat = F.col("sd") <= 1e-12 * F.abs("__mean")
    z = F.transform(a, lambda x: F.when(flat, 0.0).otherwise((x - F.col("__mean")) / F.col("sd")))
    return d.withColumn("z", z).withColumn("sd", F.when(flat, 0.0).otherwise(F.col("sd"))).drop("__mean")


def day_windows(df: DataFrame, n: int, start_hour: int = config.DAY_START_HOUR) -> DataFrame:
    """(symbol, trading_date, start_pos, start_ts, closes, sd, z): the first ``n`` closes of each day of n bars at least.

    Flat days are dropped.  Excluding today or later days is the join's matter.
    """
    d = with_position(df).withColumn("trading_date", calendar.trading_date("bar_ts", start_hour))
    day = W.partitionBy("symbol", "trading_date")
    d = d.withColumns({"__k": F.row_number().over(day.orderBy("bar_ts")), "__n": F.count("*").over(day)}).where((F.col("__k") <= n) & (F.col("__n") >= n))
    closes = F.transform(F.sort_array(F.collect_list(F.struct("bar_ts", "close"))), lambda x: x["close"])  # n of them
    w = d.groupBy("symbol", "trading_date").agg(F.min("pos").alias("start_pos"), F.min("bar_ts").alias("start_ts"), closes.alias("closes"))
    return z_normalize(w).where("sd > 0")


def decay_weights(n: int, rate: float = 0.0) -> list[float]:
    """Uniform weights, or exponential ones that favour the end; they add up to 1."""
    x = np.exp(np.linspace(-rate, 0, n)) if rate > 0 else np.ones(n)
    return (x / x.sum()).tolist()


def dealt(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries, candidates) of the windows: queries are dealt to blocks and go to every part of their series, candidates
    are dealt to parts and go to every block, by the hash of their day.  Each pair of a series shares one (symbol, block,
    part), which holds about BLOCK queries and PART candidates however long the series is."""
    counts = windows.groupBy("symbol").agg(F.count("*").alias("__n"))
    cols = ["symbol", "trading_date", "start_pos", "start_ts", "z"]
    sized = windows.join(counts, "symbol").select(*cols, *[F.ceil(F.col("__n") / size).cast("int").alias(name) for name, size in (("__blocks", BLOCK), ("__parts", PART))])
    at = lambda count: F.pmod(F.xxhash64("trading_date"), F.col(count).cast("long")).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    queries = sized.select(*cols, at("__blocks").alias("block"), every("__parts").alias("part"))
    return queries, sized.select(*[F.col(c).alias(c) for c in cols], at("__parts").alias("part"), every("__blocks").alias("block"))


def candidate_pairs(windows: DataFrame, past_only: bool = False) -> DataFrame:
    """Each window as a query (q_*) with the other windows of its series as candidates (h_*); blocks meet parts."""
    q, h = (d.select("symbol", "block", "part", *[F.col(c).alias(f"{side}_{c}") for c in ("trading_date", "start_pos", "start_ts", "z")]) for side, d in zip("qh", dealt(windows), strict=True))
    ok = F.col("h_trading_date") < F.col("q_trading_date") if past_only else F.col("h_trading_date") != F.col("q_trading_date")
    return q.join(h, ["symbol", "block", "part"]).where(ok).drop("block", "part")


def _dot(a: Column, b: Column, w: list[float]) -> Column:
    weights = F.array(*[F.lit(float(x)) for x in w])
    return F.aggregate(F.zip_with(F.zip_with(a, b, lambda x, y: x * y), weights, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def weighted_corr(q: Column, h: Column, weights: list[float]) -> Column:
    """Weighted Pearson correlation; 1e-10 is added to the denominator."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    mean = lambda a: F.aggregate(F.zip_with(a, w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    mq, mh = mean(q), mean(h)
    cov = _dot(q, h, weights) - mq * mh
    return clip(cov / (F.sqrt((_dot(q, q, weights) - mq * mq) * (_dot(h, h, weights) - mh * mh)) + 1e-10), -1.0, 1.0)


def slope_similarity(dq: Column, dh: Column) -> Column:
    return clip((F.cos(F.atan(dq) - F.atan(dh)) + 1) / 2, 0.0, 1.0)


def segment_edges(n: int) -> list[int]:
    parts = 4 if n >= 60 else 2 if n >= 20 else 1
    return np.linspace(0, n - 1, parts + 1).astype(int).tolist()


def segment_similarity(q: Column, h: Column, n: int) -> Column:
    """Mean slope similarity of 4 segments (n >= 60), 2 (n >= 20) or the whole."""
    e = segment_edges(n)
    sims = [slope_similarity(q[b] - q[a], h[b] - h[a]) for a, b in zip(e, e[1:], strict=False) if b > a]
    return sum(sims[1:], sims[0]) / len(sims)


def pivot_timing(q: Column, h: Column, n: int) -> Column:
    """1 - 0.6 * (distance of the highest + of the lowest points) / n; first occurrences count."""
    at = lambda a, best: F.array_position(a, best(a)).cast("double")
    far = F.abs(at(q, F.array_max) - at(h, F.array_max)) + F.abs(at(q, F.array_min) - at(h, F.array_min))
    return clip(1 - 0.6 * far / n, 0.0, 1.0)


def composite(corr: Column, segment: Column, pivot: Column) -> Column:
    return 0.60 * F.greatest(corr, F.lit(0.0)) + 0.25 * segment + 0.15 * pivot


def score_pairs(pairs: DataFrame, n: int, rate: float = 0.0) -> DataFrame:
    """Adds corr, segment, pivot and composite with array functions."""
    q, h = F.col("q_z"), F.col("h_z")
    d = pairs.withColumns({"corr": weighted_corr(q, h, decay_weights(n, rate)), "segment": segment_similarity(q, h, n), "pivot": pivot_timing(q, h, n)})
    return d.withColumn("composite", composite(F.col("corr"), F.col("segment"), F.col("pivot")))


def banded_dtw(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Sakoe-Chiba DTW of rows of ``a`` with rows of ``b``: root of the summed squared cost, over the length.

    The band's cells are walked once; every step works on all rows.
    """
    rows, n = a.shape
    m = b.shape[1]
    r = max(radius, abs(n - m))
    before = np.full((rows, m + 1), np.inf)
    before[:, 0] = 0.0
    for i in range(1, n + 1):
        now = np.full((rows, m + 1), np.inf)
        lo, hi = max(1, i - r), min(m, i + r)
        cost = (a[:, i - 1 : i] - b[:, lo - 1 : hi]) ** 2
        up = np.minimum(before[:, lo : hi + 1], before[:, lo - 1 : hi])
        left = now[:, lo - 1]
        for k in range(hi - lo + 1):
            left = cost[:, k] + np.minimum(up[:, k], left)
            now[:, lo + k] = left
        before = now
    return np.sqrt(before[:, m]) / n


def dtw_distance(q: Column, h: Column, radius: int = config.DTW_RADIUS) -> Column:
    """MA9 as an Arrow function over batches of pairs."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series(np.zeros(len(a)))
        sizes = pd.Series([(len(x), len(y)) for x, y in zip(a, b, strict=True)])
        for _, at in sizes.groupby(sizes).groups.items():
            out.iloc[at] = banded_dtw(np.stack(a.iloc[at].to_list()), np.stack(b.iloc[at].to_list()), radius)
        return out

    return run(q, h)


def similarity_pct(comp: Column, dtw: Column | None = None) -> Column:
    """Composite in percent, plus up to 5 either way by DTW distance, 2 digits."""
    bonus = F.lit(0.0) if dtw is None else clip((0.20 - dtw) * 25, -5.0, 5.0)
    return F.round(clip(100 * comp + bonus, 0.0, 100.0), 2)


def threshold_ladder(pairs: DataFrame, min_sim: float = config.MIN_SIMILARITY, by: tuple[str, ...] = ("symbol", "q_trading_date")) -> DataFrame:
    """Adds attempt (the first rung that some candidate reaches), threshold, passes and low_confidence.

    Rung a is max(50, min_sim - 5 a), a = 0..3.  Queries without a rung have no passing candidates.
    """
    tries, step, floor = LADDER
    best = F.max("similarity").over(W.partitionBy(*by))
    rung = lambda a: max(floor, min_sim - step * a)
    attempt = F.when(best >= rung(0), 0)
    for a in range(1, tries):
        attempt = attempt.when(best >= rung(a), a)
    d = pairs.withColumn("attempt", attempt)
    reached = F.greatest(F.lit(floor), F.lit(min_sim) - step * F.col("attempt"))
    d = d.withColumn("threshold", F.when(F.col("attempt").isNotNull(), reached))
    return d.withColumns({"passes": F.coalesce(F.col("similarity") >= F.col("threshold"), F.lit(False)), "low_confidence": F.coalesce(F.col("attempt") > 0, F.lit(False))})


def prefix_needed(k: int, radius: int, n: int) -> int:
    """Passing candidates that decide the top k: windows of a series start n bars apart at least, so a chosen one
    suppresses 2 * floor(radius / n) others at most."""
    return (k - 1) * (1 + 2 * (radius // n)) + 1


def top_k_nms(cands: DataFrame, k: int = 3, radius: int = config.NMS_RADIUS, n: int = config.WINDOW, by: tuple[str, ...] = ("symbol", "q_trading_date")) -> DataFrame:
    """Greedy by composite (ties: start_ts): a candidate that starts within ``radius`` bars of a chosen one is skipped.

    Adds ``rank``.  Only a bounded prefix of each query's passing candidates is folded.
    """
    order = W.partitionBy(*by).orderBy(F.desc("composite"), "h_start_ts")
    d = cands.where("passes").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= prefix_needed(k, radius, n))
    rest = [c for c in d.columns if c not in by and c != "__r"]
    rows = F.sort_array(F.collect_list(F.struct("__r", *rest)))

    def pick(chosen: Column, row: Column) -> Column:
        near = F.exists(chosen, lambda c: F.abs(c["h_start_pos"] - row["h_start_pos"]) <= radius)
        return F.when((F.size(chosen) < k) & ~near, F.concat(chosen, F.array(row))).otherwise(chosen)

    kind = d.select(F.array(F.struct("__r", *rest))).schema[0].dataType
    folded = d.groupBy(*by).agg(rows.alias("__rows"))
    folded = folded.withColumn("__rows", F.aggregate("__rows", F.array().cast(kind), pick))
    return folded.select(*by, F.posexplode("__rows").alias("__p", "__c")).select(*by, (F.col("__p") + 1).alias("rank"), *[F.col(f"__c.{c}").alias(c) for c in rest])


def prune_candidates(pairs: DataFrame, k: int = 3, min_sim: float = config.MIN_SIMILARITY, by: tuple[str, ...] = ("symbol", "q_trading_date")) -> DataFrame:
    """Candidates worth keeping for later calls of the day: with more than 4k of them, those of at least
    max(55, 0.75 * min_sim) before the DTW bonus, if 2k survive; otherwise all."""
    w = W.partitionBy(*by)
    good = 100 * F.col("composite") >= max(55.0, 0.75 * min_sim)
    d = pairs.withColumns({"__n": F.count("*").over(w), "__good": good, "__m": F.count_if(good).over(w)})
    prune = (F.col("__n") > 4 * k) & (F.col("__m") >= 2 * k)
    return d.where(~prune | F.col("__good")).drop("__n", "__good", "__m")


def worth_keeping(query: np.ndarray, composite: np.ndarray, similarity: np.ndarray, keep: int, rungs: list[float]) -> np.ndarray:
    """Which pairs may be chosen: for each query and rung, the ``keep`` best by composite (ties stay) of those that reach
    the rung.  A pair whose rounded similarity may lie on either side of a rung stays."""
    stays, near = np.zeros(len(query), bool), 0.0051
    for rung in rungs:
        sure = np.flatnonzero(similarity >= rung + near)
        order = sure[np.lexsort((-composite[sure], query[sure]))]
        own = query[order]
        last = order[np.arange(len(order)) - np.searchsorted(own, own) == keep - 1]
        cut = np.full(query.max(initial=-1) + 1, -np.inf)
        cut[query[last]] = composite[last]
        stays[sure] |= composite[sure] >= cut[query[sure]]
        stays |= np.abs(similarity - rung) < near
    return stays


def dtw_bound(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """A lower bound of the DTW distance of rows ``i`` of ``a`` and ``j`` of ``b``: the first and last points always meet,
    and each point meets one inside the band's envelope of the other row, whichever row is taken."""
    n = a.shape[1]

    def envelope(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = np.pad(z, ((0, 0), (radius, radius)), mode="edge")
        views = np.lib.stride_tricks.sliding_window_view(wide, 2 * radius + 1, axis=1)
        return views.max(axis=2), views.min(axis=2)

    (a_top, a_low), (b_top, b_low) = envelope(a), envelope(b)
    out = np.zeros(len(i))
    for s in range(0, len(i), DTW_ROWS):
        p, q = i[s : s + DTW_ROWS], j[s : s + DTW_ROWS]
        ends = (a[p, 0] - b[q, 0]) ** 2 + (a[p, -1] - b[q, -1]) ** 2
        outside = [(np.maximum(np.maximum(x - top, low - x), 0) ** 2).sum(axis=1) for x, top, low in ((a[p], b_top[q], b_low[q]), (b[q], a_top[p], a_low[p]))]
        out[s : s + DTW_ROWS] = np.sqrt(np.maximum(ends, np.maximum(*outside))) / n
    return out


def measured(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, composite: np.ndarray, radius: int, keep: int | None, rungs: list[float]) -> np.ndarray:
    """The DTW distance of the pairs that may be among the ``keep`` best of a query on one of the rungs; nan for others.

    Pairs are measured in the order of their composite, ever more of them in a round.  A pair is left out when its bound
    keeps it below each rung, but for those where ``keep`` better pairs are known to reach it.
    """
    far = np.full(len(i), np.nan)

    def measure(rows: np.ndarray) -> None:
        for s in range(0, len(rows), DTW_ROWS):
            own = rows[s : s + DTW_ROWS]
            far[own] = banded_dtw(a[i[own]], b[j[own]], radius)

    if keep is None or not rungs:
        measure(np.arange(len(i)))
        return far
    near, take = 0.0051, keep
    reach = np.clip(100 * composite + np.clip((0.20 - dtw_bound(a, b, i, j, radius)) * 25, -5, 5), 0, 100)
    cuts = np.full((len(rungs), i.max(initial=-1) + 1), -np.inf)
    order = np.lexsort((-composite, i))
    while True:
        wanted = np.isnan(far) & np.any([(reach >= rung - near) & (composite >= cut[i]) for rung, cut in zip(rungs, cuts, strict=True)], axis=0)
        rows = order[wanted[order]]
        if not len(rows):
            return far
        measure(rows[np.arange(len(rows)) - np.searchsorted(i[rows], i[rows]) < take])
        take *= 2
        known = order[~np.isnan(far[order])]
        sim = np.clip(100 * composite[known] + np.clip((0.20 - far[known]) * 25, -5, 5), 0, 100)
        for rung, cut in zip(rungs, cuts, strict=True):
            sure = known[sim >= rung + near]
            last = sure[np.arange(len(sure)) - np.searchsorted(i[sure], i[sure]) == keep - 1]
            cut[i[last]] = composite[last]


def similar_days(windows: DataFrame, n: int, rate: float = 0.0, past_only: bool = False, keep: int | None = None, floor: float = 0.0, dtw_radius: int | None = None, rungs: tuple[float, ...] = ()) -> DataFrame:
    """MA4-MA8 as matrix products: (symbol, q_*, h_*, corr, segment, pivot, composite) of pairs of composite >= floor.

    A task gets one (symbol, block, part) of ``dealt``.  ``keep`` leaves the best of each query in each part.  With
    ``dtw_radius`` the pairs that may be chosen are measured where their windows are, see ``measured``, ``dtw`` is added,
    and of each rung in ``rungs`` the best ``keep`` of each query stay.
    """
    weights, edges = np.array(decay_weights(n, rate)), segment_edges(n)
    q, h = dealt(windows)
    schema = "symbol string, q_trading_date date, q_start_pos long, q_start_ts timestamp, h_trading_date date, h_start_pos long, h_start_ts timestamp, corr double, segment double, pivot double, composite double"
    schema += "" if dtw_radius is None else ", dtw double"

    def centred(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = z - (z @ weights)[:, None]
        return c, (c * c) @ weights

    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[x.split()[0] for x in schema.split(", ")])
        a, b = np.stack(left["z"].to_list()), np.stack(right["z"].to_list())
        (ca, va), (cb, vb) = centred(a), centred(b)
        corr = np.clip((ca * weights) @ cb.T / (np.sqrt(np.outer(va, vb)) + 1e-10), -1, 1)
        sims = []
        for s, e in zip(edges, edges[1:], strict=False):
            if e > s:
                sims.append(np.clip((np.cos(np.arctan(a[:, e] - a[:, s])[:, None] - np.arctan(b[:, e] - b[:, s])[None]) + 1) / 2, 0, 1))
        segment = np.mean(sims, axis=0)
        far = sum(np.abs(f(a, axis=1)[:, None] - f(b, axis=1)[None]) for f in (np.argmax, np.argmin))
        pivot = np.clip(1 - 0.6 * far / n, 0, 1)
        comp = 0.60 * np.maximum(corr, 0) + 0.25 * segment + 0.15 * pivot
        qd, hd = left["trading_date"].to_numpy(), right["trading_date"].to_numpy()
        ok = (hd[None] < qd[:, None]) if past_only else (hd[None] != qd[:, None])
        ok &= comp >= floor
        if dtw_radius is None and keep is not None and comp.shape[1] > keep:
            cut = -np.sort(-np.where(ok, comp, -1), axis=1)[:, keep - 1]
            ok &= comp >= cut[:, None]  # ties stay
        i, j = np.nonzero(ok)
        dtw = {}
        if dtw_radius is not None:
            far = measured(a, b, i, j, comp[i, j], dtw_radius, keep, list(rungs))
            known = ~np.isnan(far)
            i, j, far = i[known], j[known], far[known]
            if keep is not None:
                sim = np.clip(100 * comp[i, j] + np.clip((0.20 - far) * 25, -5, 5), 0, 100)
                stays = worth_keeping(i, comp[i, j], sim, keep, list(rungs))
                i, j, far = i[stays], j[stays], far[stays]
            dtw = {"dtw": far}
        out = {"symbol": key[0]}
        for side, rows, k in (("q", left, i), ("h", right, j)):
            out |= {f"{side}_{c}": rows[c].to_numpy()[k] for c in ("trading_date", "start_pos", "start_ts")}
        return pd.DataFrame(out | {"corr": corr[i, j], "segment": segment[i, j], "pivot": pivot[i, j], "composite": comp[i, j], **dtw})

    keys = ["symbol", "block", "part"]
    return q.groupBy(*keys).cogroup(h.groupBy(*keys)).applyInPandas(compare, schema)


def match_days(df: DataFrame, n: int, k: int = 3, min_sim: float = config.MIN_SIMILARITY, radius: int = config.NMS_RADIUS, dtw_radius: int | None = config.DTW_RADIUS, rate: float = 0.0, past_only: bool = False) -> DataFrame:
    """The top ``k`` past days for every (symbol, trading day) with n bars: MA1 to MA12.

    Only the prefix that can be chosen leaves a part, with DTW one for each rung; pairs that can't reach the lowest rung
    even with the largest DTW bonus (5 percent) aren't measured.
    """
    windows = settled(day_windows(df, n), "windows")
    tries, step, floor = LADDER
    rungs = tuple(max(floor, min_sim - step * a) for a in range(tries))
    prefix = prefix_needed(k, radius, n)
    if dtw_radius is None:
        pairs = similar_days(windows, n, rate, past_only, prefix, (min(rungs) - 0.005) / 100)
        pairs = pairs.withColumn("similarity", similarity_pct(F.col("composite"))).withColumn("dtw_bonus", F.lit(0.0))
    else:
        pairs = similar_days(windows, n, rate, past_only, prefix, (min(rungs) - 5.005) / 100, dtw_radius, rungs)
        pairs = pairs.withColumn("similarity", similarity_pct(F.col("composite"), F.col("dtw")))
        pairs = pairs.withColumn("dtw_bonus", F.round(clip((0.20 - F.col("dtw")) * 25, -5.0, 5.0), 2)).drop("dtw")
    return top_k_nms(threshold_ladder(pairs, min_sim), k, radius, n)
