"""Bar operators: hand-made cases, equivalences and plain Python restatements."""

import math
import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barweave.functions import windows as V
from barweave.operators import backtest as B
from barweave.operators import calendar as K
from barweave.operators import cleaning as C
from barweave.operators import evaluation as E
from barweave.operators import features as X
from barweave.operators import forecast as P
from barweave.operators import matching as M
from barweave.operators import model as L
from barweave.operators import reporting as R
from barweave.operators import storage as S
from barweave.streaming import bars as Z

T0 = datetime(2024, 1, 1)
BAR = "symbol string, bar_ts timestamp, open double, high double, low double, close double, volume double"


def make_bars(spark, n, symbol="a", step=60, seed=0, flat=None):
    r = random.Random(seed)
    rows, p = [], 100.0
    for i in range(n):
        p = flat if flat is not None else p + r.uniform(-1, 1)
        rows.append((symbol, T0 + timedelta(minutes=step * i), p, p + 0.5, p - 0.5, p, float(r.randint(10, 99))))
    return spark.createDataFrame(rows, BAR)


def values(df, *cols, order="bar_ts"):
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.orderBy("symbol", order).select(*cols).collect()]


def test_dtw_of_shifted_sine():
    x = np.linspace(0, 2 * np.pi, 50)
    d = M.banded_dtw(np.sin(x)[None], np.sin(x - 0.2)[None], 5)[0]
    assert 0 < d < 0.5


def test_dtw_against_plain_loop():
    r = np.random.default_rng(0)
    a, b = r.standard_normal((4, 12)), r.standard_normal((4, 15))
    for k in range(4):
        n, m, w = 12, 15, 3
        d = np.full((n + 1, m + 1), np.inf)
        d[0, 0] = 0
        for i in range(1, n + 1):
            for j in range(max(1, i - w), min(m, i + w) + 1):
                d[i, j] = (a[k, i - 1] - b[k, j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
        assert M.banded_dtw(a, b, w)[k] == pytest.approx(math.sqrt(d[n, m]) / n)


def test_flat_series_has_no_match(spark):
    b = make_bars(spark, 24 * 4, flat=500.0)
    w = M.day_windows(b, 20)
    assert w.count() == 0 and M.match_days(b, 20, dtw_radius=None).count() == 0


def test_worth_keeping_against_sorting():
    r = np.random.default_rng(3)
    for _ in range(50):
        query, comp, sim = r.integers(0, 5, 60), r.integers(0, 12, 60) / 12, r.uniform(40, 80, 60)
        got = M.worth_keeping(query, comp, sim, 3, [70.0, 60.0])
        want = np.zeros(60, bool)
        for q in range(5):
            for rung in (70.0, 60.0):
                own = [i for i in range(60) if query[i] == q and sim[i] >= rung + 0.0051]
                least = sorted((comp[i] for i in own), reverse=True)[:3][-1:] or [9.0]
                want[[i for i in own if comp[i] >= least[0]]] = True
        want |= (np.abs(sim - 70) < 0.0051) | (np.abs(sim - 60) < 0.0051)
        assert (got == want).all()
    assert M.worth_keeping(np.zeros(0, int), np.zeros(0), np.zeros(0), 3, [70.0]).shape == (0,)


def test_dtw_bounds_are_never_above_the_distance():
    r = np.random.default_rng(4)
    for n, radius in ((8, 1), (24, 3), (24, 30)):
        a, b = r.standard_normal((200, n)), r.standard_normal((200, n)).cumsum(axis=1)
        i, j = r.integers(0, 200, 500), r.integers(0, 200, 500)
        bound = M.dtw_bound(a, b, i, j, radius)
        assert (bound <= M.banded_dtw(a[i], b[j], radius) + 1e-12).all() and bound.mean() > 0


def test_few_pairs_are_measured_and_none_is_missed():
    """Days in clusters: the bound and the best so far spare most measurements, and what may be chosen is the same."""
    r = np.random.default_rng(5)
    shapes = r.standard_normal((12, 24)).cumsum(axis=1)
    z = np.concatenate([shapes + 0.3 * r.standard_normal((12, 24)) for _ in range(10)])
    z = (z - z.mean(axis=1, keepdims=True)) / z.std(axis=1, keepdims=True)
    corr = np.clip(z @ z.T / 24, 0, 1)
    i, j = np.nonzero((corr > 0.4) & ~np.eye(len(z), dtype=bool))
    comp, rungs = corr[i, j], [70.0, 65.0, 60.0, 55.0]
    whole = M.banded_dtw(z[i], z[j], 3)
    sim = np.clip(100 * comp + np.clip((0.20 - whole) * 25, -5, 5), 0, 100)
    want = M.worth_keeping(i, comp, sim, 3, rungs)
    far = M.measured(z, z, i, j, comp, 3, 3, rungs)
    known = ~np.isnan(far)
    assert np.allclose(far[known], whole[known])
    stays = M.worth_keeping(i[known], comp[known], np.clip(100 * comp[known] + np.clip((0.20 - far[known]) * 25, -5, 5), 0, 100), 3, rungs)
    # every pair that is among the best of a rung is measured and kept; others that stay lie on a rung's edge
    for rung in rungs:
        for q in np.unique(i):
            own = np.flatnonzero((i == q) & (sim >= rung + 0.0051))
            best = own[np.argsort(-comp[own], kind="stable")[:3]]
            assert known[best].all() and stays[np.searchsorted(np.flatnonzero(known), best)].all()
    assert want.sum() >= stays.sum() and known.mean() < 0.4, f"{known.mean():.2f} of the pairs were measured"


def test_matches_with_dtw_against_all_pairs(spark, monkeypatch):
    b = make_bars(spark, 24 * 40, seed=5).union(make_bars(spark, 24 * 9, symbol="b", seed=6))
    w = M.day_windows(b, 20)
    monkeypatch.setattr(M, "BLOCK", 7)
    monkeypatch.setattr(M, "PART", 5)
    monkeypatch.setattr(M, "DTW_ROWS", 11)
    pairs = M.candidate_pairs(w)
    days = {r.symbol: r.n for r in w.groupBy("symbol").agg(F.count("*").alias("n")).collect()}
    assert pairs.count() == pairs.select("symbol", "q_trading_date", "h_trading_date").distinct().count() == sum(n * (n - 1) for n in days.values())
    s = M.score_pairs(pairs, 20).withColumn("dtw", M.dtw_distance(F.col("q_z"), F.col("h_z"), 3)).drop("q_z", "h_z")
    s = s.withColumn("similarity", M.similarity_pct(F.col("composite"), F.col("dtw")))
    cols = ["symbol", "q_trading_date", "rank", "h_trading_date", "similarity", "attempt"]
    for least, radius in ((70.0, 23), (90.0, 60)):
        want = M.top_k_nms(M.threshold_ladder(s, least), 3, radius, 20).select(cols)
        got = M.match_days(b, 20, min_sim=least, radius=radius, dtw_radius=3).select(cols)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 30


def test_scratch_folder_of_a_local_session_without_a_setting(spark):
    from barweave.functions import scratch

    class Unset:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda key, default: default)}), spark.sparkContext

    a, b = scratch.shared_path(Unset, "x"), scratch.shared_path(Unset, "x")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]


def test_top_k_skips_near_starts(spark):
    rows = [("a", "2024-02-01", p, T0 + timedelta(hours=p), c, 90.0, True) for p, c in [(0, 0.9), (24, 0.95), (48, 0.8), (96, 0.95), (120, 0.7)]]
    d = spark.createDataFrame(rows, "symbol string, q_trading_date string, h_start_pos long, h_start_ts timestamp, composite double, similarity double, passes boolean")
    got = [r.h_start_pos for r in M.top_k_nms(d, 3, 30, 24).orderBy("rank").collect()]
    assert got == [24, 96]  # ties by start; 0, 48 and 120 are near


def test_ladder_rungs(spark):
    d = spark.createDataFrame([("a", "x", s) for s in (66.0, 64.0)] + [("a", "y", 54.9), ("a", "z", 71.0), ("a", "z", 60.0)], "symbol string, q_trading_date string, similarity double")
    got = sorted((r.q_trading_date, r.similarity, r.attempt, r.passes, r.low_confidence) for r in M.threshold_ladder(d).collect())
    assert got == [("x", 64.0, 1, False, True), ("x", 66.0, 1, True, True), ("y", 54.9, None, False, False), ("z", 60.0, 0, False, False), ("z", 71.0, 0, True, False)]


def test_trading_day_starts_at_six(spark):
    d = spark.createDataFrame([(datetime(2024, 1, 2, 5, 59, 59),), (datetime(2024, 1, 2, 6),)], "bar_ts timestamp")
    assert [str(r[0]) for r in d.select(K.trading_date("bar_ts")).collect()] == ["2024-01-01", "2024-01-02"]


def test_gap_threshold_is_exclusive(spark):
    b = spark.createDataFrame([("a", T0 + timedelta(minutes=m), 1.0, 1.0, 1.0, 1.0, 1.0) for m in (0, 15, 31)], BAR)
    assert values(C.flag_gaps(b, 15), "is_gap") == [False, False, True]


def test_spike_is_replaced_inside_and_at_the_edge(spark):
    rows = [("a", T0 + timedelta(minutes=i), *[100.0 + (50 if i in (0, 20) else 0)] * 4, 1.0) for i in range(30)]
    assert values(C.filter_spikes(spark.createDataFrame(rows, BAR)), "close") == [100.0] * 30


def test_first_write_stays_and_last_write_wins(spark):
    old = spark.createDataFrame([("a", T0, 1.0, 1.0, 1.0, 1.0, 5.0)], BAR)
    new = spark.createDataFrame([("a", T0, 2.0, 2.0, 2.0, 2.0, None), ("a", T0 + timedelta(minutes=1), 3.0, 3.0, 3.0, 3.0, None)], BAR)
    assert values(S.append_new_bars(old, new), "close", "volume") == [(1.0, 5.0), (3.0, 0.0)]
    got = S.upsert_latest(old.withColumn("v", F.lit(1)), new.withColumn("v", F.lit(1)), ["symbol", "bar_ts"], "v")
    assert values(got, "close") == [2.0, 3.0]


def test_chunks_equal_one_window(spark):
    b = make_bars(spark, 500)
    steps = (X.rsi(), X.range_position(), X.volume_imbalance(), X.market_regime(), X.kalman_level())
    cols = ("rsi", "range60", "imbalance", "regime_score", "kalman")
    whole, cut = values(X.apply(b, *steps, chunk=10_000), *cols), values(X.apply(b, *steps, chunk=64), *cols)
    assert np.allclose(np.array(whole), np.array(cut), atol=1e-9)


def test_ewm_is_the_adjusted_mean(spark):
    p = values(make_bars(spark, 900), "close")
    got = values(X.ewm(make_bars(spark, 900)), "ema")
    num = den = 0.0
    for x, g in zip(p, got, strict=True):
        num, den = num * 19 / 21 + x, den * 19 / 21 + 1
        assert g == pytest.approx(num / den, rel=1e-12)


def test_affine_scan_over_chunks(spark):
    r = random.Random(1)
    rows = [("a", T0 + timedelta(days=i), r.random(), r.random()) for i in range(100)]
    got = [x[0] for x in V.affine_scan(spark.createDataFrame(rows, "symbol string, ts timestamp, a double, b double"), "a", "b", "x", start=2.0, chunk=7).orderBy("ts").select("x").collect()]
    x = 2.0
    for (_, _, a, b), g in zip(rows, got, strict=True):
        x = a * x + b
        assert g == pytest.approx(x)


def test_incremental_equals_full(spark):
    r = random.Random(2)
    rows = [("a", T0 + timedelta(seconds=61 * i), i, 100 + r.gauss(0, 10), 1.0, "s") for i in range(900)]
    t = spark.createDataFrame(rows, "symbol string, ts timestamp, event_id long, price double, volume double, source string")
    full = values(C.clean_series(t, "5 minutes"), "bar_ts", "close", "volume", "is_gap")
    for cut in (100, 455, 899):
        snap = C.clean_series(t.where(F.col("event_id") < cut), "5 minutes")
        assert values(C.incremental_refresh(snap, t, "5 minutes"), "bar_ts", "close", "volume", "is_gap") == full


def test_feature_vector_of_short_and_linear_series(spark):
    rows = [("a", T0 + timedelta(minutes=i), 880 + i / 15, 880.5 + i / 15, 879.5 + i / 15, 880.1 + i / 15, 50.0) for i in range(30)]
    v = values(X.feature_vector(X.bar_features(spark.createDataFrame(rows, BAR))), "features")
    assert all(x == [0.0] * 20 for x in v[:19]) and all(len(x) == 20 and all(-3 <= y <= 3 for y in x) for x in v) and any(v[19])


def test_match_at_the_end_of_history_carries_its_anchor(spark):
    b = make_bars(spark, 10)
    m = spark.createDataFrame([("a", "q", 1, 6)], "symbol string, q_trading_date string, rank int, h_start_pos long")
    got = P.match_future(m, b, 4, 6).first()
    assert got.future == [got.anchor] * 6 == values(b, "close")[-1:] * 6


def test_no_direct_flip_of_advice():
    assert P.next_advice("STRONG_BUY", "STRONG_SELL", 0.0, 0.9, 3) == "WAIT"
    assert P.next_advice("BUY_DIP", "SELL_RISK", 2.5, 0.85, 16) == "BUY_DIP"
    assert P.next_advice("BUY_DIP", "SELL_RISK", 2.4, 0.85, 16) == "SELL_RISK"


def test_online_step_reduces_the_error_and_is_seeded(spark):
    x, y = np.linspace(-1, 1, 20), np.full(6, 1e-4)
    flat, v = L.initial_weights("a"), np.zeros(sum(L.SIZES))
    assert (flat == L.initial_weights("a")).all() and (flat != L.initial_weights("b")).any()
    errors = []
    for k in range(50):
        flat, v, e = L.sgd_step(flat, v, k, x, y)
        errors.append(e)
    assert errors[-1] < errors[0] and np.isfinite(flat).all()
    rows = [("a", T0 + timedelta(minutes=i), x.tolist(), y.tolist()) for i in range(20)]
    s = spark.createDataFrame(rows, "symbol string, ts timestamp, features array<double>, returns array<double>")
    once = L.fit_online(s).first()
    half = L.fit_online(s.where(F.minute("ts") < 10))
    twice = L.fit_online(s.where(F.minute("ts") >= 10), half).first()
    assert once.train_count == twice.train_count == 20 and np.allclose(once.weights, twice.weights)


def test_empty_tables(spark):
    e = make_bars(spark, 0)
    assert C.flag_gaps(C.filter_spikes(e)).collect() == [] and X.bar_features(e).collect() == [] and M.day_windows(e, 6).collect() == []
    assert C.upsample_interpolate(e, "1 hour").collect() == []


def test_asof_join_of_a_shared_table(spark, tmp_path):
    """Without a key every series takes its rates from one table, which isn't copied; rows without a time stay."""
    r = random.Random(6)
    left = [(s, None if i == 7 else T0 + timedelta(minutes=r.randint(0, 6000)), float(i)) for s in "abc" for i in range(60)]
    right = sorted({T0 + timedelta(minutes=r.randint(500, 5000)) for _ in range(40)})
    d = spark.createDataFrame(left, "symbol string, ts timestamp, v double")
    rates = spark.createDataFrame([(t, float(k)) for k, t in enumerate(right)] + [(None, 99.0)], "ts timestamp, rate double")
    for unit in ("hour", "day", "month"):
        found = C.asof_join(d, rates, ["rate"], by=(), unit=unit)
        for x in found.collect():
            before = [k for k, t in enumerate(right) if x.ts is not None and t <= x.ts]
            assert (x.rate, x.right_ts) == ((float(before[-1]), right[before[-1]]) if before else (None, None))
        assert found.count() == len(left)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_asof_join_gives_rates_to_every_series(spark, tmp_path):
    rows = [(1, "2024-03-01 00:10:00", 1, "view", 10.0, '{"k": 1}'), (2, "2024-03-01 01:10:00", 2, "metal", 5.0, '{"k": 2}')]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    e.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.symbol: (r.rate, r.right_ts) for r in entry.queries()["cl7_asof_join"](spark, str(tmp_path)).collect()}
    assert got == {"view": (None, None), "metal": (2.0, "2024-03-01 00:10:00")}


def test_refresh_reads_and_writes_the_last_months_alone(spark, tmp_path):
    """Five months of bars, new ticks in the last two: equal to a rebuild, older months keep their files, twice is once."""
    r = random.Random(8)
    rows = [(s, T0 + timedelta(hours=7 * i), i, 100 + r.gauss(0, 10), 1.0, "s") for s in "ab" for i in range(500 if s == "a" else 90)] + [("new", T0 + timedelta(hours=3400), 1, 5.0, 1.0, "s")]
    t = spark.createDataFrame(rows, "symbol string, ts timestamp, event_id long, price double, volume double, source string").persist()
    shown = lambda d: values(d, "symbol", "bar_ts", "close", "volume", "is_gap")
    path = f"{tmp_path}/clean"
    old = t.where(F.col("ts") < F.lit(T0 + timedelta(hours=3000)))
    C.write_months(C.clean_series(old, "1 hour", gap=600.0), path)
    files = {f: os.path.getmtime(f"{path}/{d}/{f}") for d in os.listdir(path) if d < "month=2024-04" and d.startswith("month") for f in os.listdir(f"{path}/{d}") if f.endswith("parquet")}
    for _ in range(2):
        months = C.refresh_months(spark, path, t, "1 hour", gap=600.0)
        assert shown(spark.read.parquet(path).drop("month")) == shown(C.clean_series(t, "1 hour", gap=600.0))
        # series b has ended long ago: its last bars are checked again
        assert set(months) <= {"2024-01", "2024-04", "2024-05"}
    assert sum(os.path.exists(f"{path}/month=2024-0{k}/{f}") for f in files for k in (2, 3)) == sum(1 for d in ("month=2024-02", "month=2024-03") for f in os.listdir(f"{path}/{d}") if f.endswith("parquet"))


def test_current_query_ranks_the_last_months_alone(spark):
    rows = [("a", T0 + timedelta(hours=i), float(i)) for i in range(24 * 150)] + [("b", T0 + timedelta(days=31 * k), float(k)) for k in range(5)]
    d = spark.createDataFrame(rows, "symbol string, bar_ts timestamp, close double")
    got = {x.symbol: x.closes for x in K.current_query(d, min_points=40).collect()}
    assert got == {"a": [float(i) for i in range(24 * 150 - 40, 24 * 150)], "b": [0.0, 1.0, 2.0, 3.0, 4.0]}
    assert len(K.current_query(d, min_points=2, borrow=False).where("symbol = 'a'").first().closes) == 18


def test_ingest_with_a_fresh_checkpoint_keeps_the_table(spark, tmp_path):
    schema, n = "symbol string, bar_ts timestamp, close double", iter(range(9))

    def run(rows, checkpoint):
        path = f"{tmp_path}/in{next(n)}"
        spark.createDataFrame([("a", T0 + timedelta(days=40 * m), float(c)) for m, c in rows], schema).write.parquet(path)
        source = spark.readStream.schema(schema).parquet(path)
        Z.stream_ingest(source, f"{tmp_path}/table", f"{tmp_path}/{checkpoint}").awaitTermination()
        return sorted((r.bar_ts, r.close) for r in spark.read.parquet(f"{tmp_path}/table").collect())

    at = lambda m: T0 + timedelta(days=40 * m)
    assert run([(0, 1), (1, 1), (1, 2)], "one") == [(at(0), 1.0), (at(1), 1.0)]
    assert run([(0, 5), (2, 5)], "two") == [(at(0), 1.0), (at(1), 1.0), (at(2), 5.0)]
    assert run([(2, 7), (3, 7)], "three") == [(at(0), 1.0), (at(1), 1.0), (at(2), 5.0), (at(3), 7.0)]


def test_win_rate_by_newly_due_rows(spark):
    rows = [(s, T0 + timedelta(hours=h), int(h % 3 == 0), 1, None) for s in "abc" for h in range(40 if s != "c" else 3)]
    d = spark.createDataFrame(rows, "symbol string, target_time timestamp, is_direction_correct int, is_advice_correct int, is_range_correct int")
    due = spark.createDataFrame([("a",), ("a",), ("c",)], "symbol string")
    rate = lambda hours: 100 * (0.5 * sum(h % 3 == 0 for h in hours) / len(hours) + 0.3)
    got = {r.symbol: (r.n, round(r.win_rate, 6)) for r in E.win_rate(d, F.lit(T0 + timedelta(hours=32)), due).collect()}
    want = {"a": range(32, 40), "b": range(20, 40), "c": range(3)}
    assert got == {s: (len(h), round(rate(h), 6)) for s, h in want.items()}
    late = {r.symbol: r.n for r in E.win_rate(d, F.lit(T0 + timedelta(hours=38))).collect()}
    assert late == {"a": 30, "b": 30, "c": 3}


def forecast_case(spark, steps, feedback=None):
    b = make_bars(spark, 24 * 12, seed=5)
    w, m = M.day_windows(b, 20), M.match_days(b, 20, radius=23, dtw_radius=None)
    return {r.q_trading_date: r for r in P.generate_forecast(b, w, m, 20, steps, feedback, minutes=60).collect()}


@pytest.mark.parametrize("steps", [6, 12])
def test_forecast_takes_its_biases_off(spark, steps):
    plain = forecast_case(spark, steps)
    told = spark.createDataFrame([("a", 50.0, 2.0, 0.4, 0.2, 0.5, [0.1, 0.2])], "symbol string, win_rate double, k double, high_bias double, low_bias double, inst_factor double, step_biases array<double>")
    got = forecast_case(spark, steps, told)
    some = [d for d in plain if plain[d].valid_count]
    assert some and len(some) < len(plain) + 1 and set(got) == set(plain)
    for d in some:
        a, g = plain[d], got[d]
        for i in range(steps):
            if steps == 6:
                shift = -[0.1, 0.2][min(i, 1)]
            else:
                limit = a.last_price * 0.003
                shift = max(-limit, min(limit, 0.3)) + 0.5 * P.config.INST_DRIFT * math.sqrt(i + 1)
            assert g.predicted[i] - a.predicted[i] == pytest.approx(shift, abs=0.011)
            assert g.upper[i] - g.predicted[i] == pytest.approx(2 * (a.upper[i] - a.predicted[i]), rel=0.02, abs=0.03)
        assert g.rest_high == pytest.approx(a.rest_high + 0.5 * 0.25 + min(0.4, a.last_price * 0.005), abs=1e-9)
        assert all(x >= p + 0.04 for x, p in zip(a.q_upper, a.predicted, strict=True)) and len(a.tracks) == a.valid_count
        assert len(a.top1_track) <= 20 + steps and a.high_time and a.low_time
    none = [d for d in plain if not plain[d].valid_count]
    assert all(plain[d].advice == "NEUTRAL" and plain[d].label == "no data" for d in none)


def test_match_features_against_plain_python(spark):
    rows = [("a", T0, 90.0, [1.0, 2.0]), ("a", T0, 80.0, [5.0, 4.5]), ("a", T0, 70.0, [1.0, 1.0]), ("b", T0, 60.0, [])]
    t = spark.createDataFrame(rows, "symbol string, bar_ts timestamp, similarity double, path array<double>")
    last = spark.createDataFrame([("a", T0, 10.0), ("b", T0, 10.0)], "symbol string, bar_ts timestamp, close double")
    got = {r.symbol: (r.hist_sim, r.hist_consensus, r.hist_return) for r in X.match_features(t, last).collect()}
    assert got["a"] == pytest.approx((0.8, 0.0, (1 - 0.5 + 0) / 3 / 10 * 100)) and got["b"] == pytest.approx((0.6, 0.0, 0.0))


def test_backtest_cutoffs_and_sharpe(spark):
    b = make_bars(spark, 24 * 14, seed=6)
    every = {r.q_trading_date: r for r in B.backtest(b, 20, radius=23).collect()}
    few = {r.q_trading_date: r for r in B.backtest(b, 20, radius=23, cutoffs=4).collect()}
    assert few and set(few) <= set(every) and all(few[d] == every[d] for d in few) and len(few) <= 4 < len(every)
    closes = dict(zip(values(b, "bar_ts"), values(b, "close"), strict=True))
    for r in every.values():
        assert r.actual_end in closes.values() and r.mape >= 0
    r = [(1.0, 1.2, 1.3), (1.0, 0.8, 1.1), (1.0, 1.01, 2.0), (2.0, 2.5, 2.2)]
    d = spark.createDataFrame([("a", *x, 1.0) for x in r], "symbol string, last_price double, predicted_end double, actual_end double, mape double")
    m = B.backtest_metrics(d).first()
    x = np.array([0.3, -0.1, 0.1])
    assert (m.n, m.signals) == (4, 3) and m.win_rate == pytest.approx(200 / 3) and m.sharpe == pytest.approx(x.mean() / (x.std() + 1e-8) * (252 * 1440) ** 0.5)


def test_timeline_has_the_tracks(spark):
    b = make_bars(spark, 8).union(make_bars(spark, 8, symbol="b", seed=1))
    f = spark.createDataFrame([("a", k, 1.0, 2.0, 0.0) for k in (1, 2, 3)], "symbol string, step int, predicted double, upper double, lower double")
    p = spark.createDataFrame([], "symbol string, ts timestamp, price double, advice_type string")
    paths = [(1, [7.0, 8.0, 9.0]), (2, [6.0, 5.0, 4.0])]
    t = spark.createDataFrame([("a", paths)], "symbol string, tracks array<struct<rank:int,path:array<double>>>")
    for top1, want in (([1.0, 2.0, 3.0, 4.0], [None] * 4 + [1.0, 2.0, 3.0, 4.0]), ([float(i) for i in range(20)], [float(i) for i in range(12, 20)])):
        o = spark.createDataFrame([("a", top1)], "symbol string, top1_track array<double>")
        rows = R.timeline(b, f, p, 5, 3, "1 hour", o, t).orderBy("symbol", "ts").collect()
        a, other = [r for r in rows if r.symbol == "a"], [r for r in rows if r.symbol == "b"]
        assert len(a) == len(other) == 8 and [r.top1 for r in a] == want
        assert all(r.tracks is None for r in a[:4]) and all(r.top1 is None and r.tracks is None for r in other)
        assert [[tuple(x) for x in r.tracks] for r in a[4:]] == [[(1, a[4].real), (2, a[4].real)], [(1, 7.0), (2, 6.0)], [(1, 8.0), (2, 5.0)], [(1, 9.0), (2, 4.0)]]
    assert "top1" not in R.timeline(b, f, p, 5, 3, "1 hour").columns
