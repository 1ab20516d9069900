"""Feedback as of a moment, the online model batch by batch, recurrences over many chunks, forecasts without later bars."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.functions import windows
from barweave.jobs import forecast_queries
from barweave.operators import evaluation as E
from barweave.operators import feedback as V
from barweave.operators import forecast as P
from barweave.operators import model as L

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def sample_rows(seed, n):
    r = np.random.default_rng(seed)
    return [("abc"[int(r.integers(0, 3))], T0 + i * HOUR, r.standard_normal(20).tolist(), (r.standard_normal(6) * 1e-3).tolist()) for i in range(n)]


SAMPLES = "symbol string, ts timestamp, features array<double>, returns array<double>"


def looped(rows, seed=0):
    """Weights, momentum, count and both errors of each series after its rows in time order."""
    out = {}
    for symbol in sorted({x[0] for x in rows}):
        flat, ema, last = L.initial_weights(symbol, seed), 0.0, 0.0
        velocity = np.zeros_like(flat)
        for k, (_, _, x, y) in enumerate(sorted((x for x in rows if x[0] == symbol), key=lambda x: x[1])):
            flat, velocity, last = L.sgd_step(flat, velocity, k, np.array(x), np.array(y))
            ema = last if ema == 0.0 else 0.8 * ema + 0.2 * last
        out[symbol] = (flat, velocity, k + 1, ema, last)
    return out


def test_learning_goes_on_from_batch_to_batch(spark):
    """Batches of seven rows, and a stop in the middle, give the weights of one plain loop."""
    rows = sample_rows(1, 90)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        d = spark.createDataFrame(rows, SAMPLES).repartition(3)
        got = {x.symbol: x for x in L.fit_online(d).collect()}
        half = L.fit_online(d.where(F.col("ts") < F.lit(T0 + 40 * HOUR)))
        resumed = {x.symbol: x for x in L.fit_online(d.where(F.col("ts") >= F.lit(T0 + 40 * HOUR)), half.persist()).collect()}
        same = {x.symbol: x for x in L.fit_online(d.limit(0), half).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for symbol, (flat, velocity, n, ema, last) in looped(rows).items():
        for x in (got[symbol], resumed[symbol]):
            assert x.train_count == n and np.array_equal(x.weights, flat) and np.array_equal(x.momentum, velocity) and (x.ema_mse, x.last_mse) == (ema, last)
    assert {k: x.train_count for k, x in same.items()} == {k: v[2] for k, v in looped(rows[:40]).items()}


def test_replay_sees_nothing_later(spark):
    rows = sample_rows(2, 60)
    asked = [(s, f"{s}{i}", T0 + dt.timedelta(minutes=i), None if i == 90 else np.full(20, 0.1).tolist()) for s in "ad" for i in (-5, 90, 600, 601, 10_000)]
    d = spark.createDataFrame(rows, SAMPLES)
    q = spark.createDataFrame(asked, "symbol string, key string, ts timestamp, features array<double>")
    got = {x.key: x for x in L.replay(d, q).collect()}
    for symbol, key, ts, x in asked:
        known = [r for r in rows if r[0] == symbol and r[1] <= ts]
        flat, _, n, ema, _ = looped(known)[symbol] if known else (L.initial_weights(symbol), None, 0, 0.0, 0.0)
        w1, b1, w2, b2 = L.unpack(flat)
        bound = min(0.0003 + n * 1e-5, 0.0008)
        assert got[key].train_count == n and got[key].mse == ema
        assert got[key].returns is None if x is None else np.allclose(got[key].returns, np.clip(np.tanh(np.array(x) @ w1 + b1) @ w2 + b2, -bound, bound))


def test_model_predict_against_numpy(spark):
    rows = sample_rows(3, 20)
    state = L.fit_online(spark.createDataFrame(rows, SAMPLES)).persist()
    d = spark.createDataFrame([(s, i, x[: 20 - 3 * (i % 2)], 50.0 + i) for i, (s, _, x, _) in enumerate(rows)], "symbol string, i int, features array<double>, last_price double")
    models = {x.symbol: x for x in state.collect()}
    for x in L.model_predict(d, state).collect():
        m = models[x.symbol]
        w1, b1, w2, b2 = L.unpack(np.array(m.weights))
        bound = min(0.0003 + m.train_count * 1e-5, 0.0008)
        inputs = np.concatenate([x.features, np.zeros(20 - len(x.features))])
        want = np.clip(np.tanh(inputs @ w1 + b1) @ w2 + b2, -bound, bound)
        assert np.allclose(x.returns, want) and np.allclose(x.path, x.last_price * np.cumprod(1 + want))


def test_starts_over_many_chunks(spark):
    """Chunks of one row and three maps to a block: three levels, against a plain loop; both recurrences in one scan."""
    r = random.Random(3)
    rows = [("ab"[i % 2], T0 + i * HOUR, r.random(), r.random(), r.choice([1.0, 0.5]), r.random()) for i in range(80)]
    d = spark.createDataFrame(rows, "symbol string, ts timestamp, a double, b double, c double, e double")
    old = windows.carried.__defaults__
    windows.carried.__defaults__ = (("symbol",), 3)
    try:
        got = windows.affine_scans(d, {"x": ("a", "b"), "y": ("c", "e")}, start=2.0, chunk=1).orderBy("ts").collect()
        advice = [(s, ts, r.choice(P.ADVICE), 3.0 * r.random(), r.random(), r.randint(1, 30)) for s, ts, *_ in rows]
        a = spark.createDataFrame(advice, "symbol string, q_trading_date timestamp, advice_raw string, upside double, position double, high_step int")
        said = {(x.symbol, x.q_trading_date): x.advice for x in P.advice_state(a, chunk=1).collect()}
    finally:
        windows.carried.__defaults__ = old
    x, y, last = {}, {}, {}
    for row, (s, _, a, b, c, e) in zip(got, rows, strict=True):
        x[s], y[s] = a * x.get(s, 2.0) + b, c * y.get(s, 2.0) + e
        assert abs(row.x - x[s]) < 1e-12 and abs(row.y - y[s]) < 1e-12
    for s, ts, raw, up, pos, peak in advice:
        last[s] = P.next_advice(last.get(s, "WAIT"), raw, up, pos, peak)
        assert said[(s, ts)] == last[s]


def test_a_row_gathers_few_maps(spark):
    """The plan has three windows over blocks and none over all chunks of a series."""
    d = spark.createDataFrame([("a", T0, 1.0, 1.0)], "symbol string, ts timestamp, a double, b double")
    plan = windows.affine_scan(d, "a", "b", "x")._jdf.queryExecution().optimizedPlan().toString()
    gathers = [line for line in plan.split("\n") if "collect_list" in line and "windowspecdefinition" in line]
    assert len(gathers) == 3 and sum("__block" in line.split("windowspecdefinition")[1].split("ASC")[0] for line in gathers) >= 2


def test_rows_without_a_time_stay(spark):
    rows = [("a", None, 1.0), ("a", T0, 2.0), ("a", T0 + 40 * 24 * HOUR, None)]
    d = spark.createDataFrame(rows, "symbol string, ts timestamp, v double")
    assert sorted(x.pos for x in windows.with_position(d, order="ts").collect()) == [0, 1, 2]
    assert windows.running_sums(d, {"total": "v"}, order="ts").count() == 3
    assert sorted((x.v for x in windows.fill(d, ["v"]).collect())) == [1.0, 2.0, 2.0]
    from barweave.operators.cleaning import asof_join

    found = {x.ts: x.w for x in asof_join(d, d.select("symbol", "ts", F.col("v").alias("w")), ["w"]).collect()}
    assert found == {None: None, T0: 2.0, T0 + 40 * 24 * HOUR: None}


def scored_rows(seed, n=70):
    r = random.Random(seed)
    out = []
    for i in range(n):
        target = T0 + i * HOUR
        seen = target + dt.timedelta(hours=r.choice([0, 0, 0, 1, 5])) if not out else max(out[-1][2], target + dt.timedelta(hours=r.choice([0, 0, 0, 1, 30 if i == 40 else 2])))
        price = 50 + r.random() * 10
        closes = [price + r.random() for _ in range(r.choice([6, 6, 6, 3]))]
        out.append(("a", target, seen, closes, seen + 5 * HOUR, price, 50 + r.random() * 10, 50 + r.random() * 10, 58.0, 52.0, *(r.randint(0, 1) for _ in range(3))))
    return out


def test_feedback_of_a_moment(spark):
    rows = scored_rows(4)
    names = "symbol string, target_time timestamp, actual_ts timestamp, closes array<double>, closes_ts timestamp, actual_price double, base_price double, predicted_price double, upper_bound double, lower_bound double, is_direction_correct int, is_advice_correct int, is_range_correct int"
    moments = [("a", T0.date() + dt.timedelta(days=k), T0 + dt.timedelta(hours=h)) for k, h in enumerate((-1, 0, 3, 9, 20, 31, 45, 52, 66, 500))] + [("b", T0.date(), T0)]
    m = spark.createDataFrame(moments, "symbol string, q_trading_date date, as_of timestamp")
    got = {(x.symbol, x.q_trading_date): x for x in V.as_of(spark.createDataFrame(rows, names), m).collect()}
    assert len(got) == len(moments)
    for symbol, day, t in moments:
        known = [x for x in rows if x[0] == symbol and x[2] <= t]
        x = got[(symbol, day)]
        if not known:
            assert x.win_rate is None and x.high_bias is None
            continue
        value = lambda part: 100 * sum(0.5 * v[10] + 0.3 * v[11] + 0.2 * v[12] for v in part) / len(part)
        start = (t - 6 * HOUR).replace(hour=0, minute=0) + 6 * HOUR
        today = [v for v in known if v[1] >= start]
        fresh = any(v[2] > t - HOUR for v in known)
        want = value(known[-20:]) if not fresh else value(today) if len(today) >= 5 else value(known[-30:])
        assert abs(x.win_rate - want) < 1e-9
        high = low = 0.0
        for v in known:
            price, hi, lo = v[5], v[8], v[9]
            high = 0.3 * (price - hi) + 0.7 * high if price > hi else 0.7 * (price - hi) * 0.1 + 0.3 * high if price < hi - 3 else high
            low = 0.3 * (price - lo) + 0.7 * low if price < lo else 0.7 * (price - lo) * 0.1 + 0.3 * low if price > lo + 3 else low
        assert abs(x.high_bias - high) < 1e-9 and abs(x.low_bias - low) < 1e-9
        bias = [0.0] * 6
        for v in (v for v in rows if v[4] <= t and len(v[3]) == 6):
            first = v[6] + (v[7] - v[6]) * 0.167
            bias = [0.75 * b + 0.25 * (first + (v[7] - first) * i / 5 - c) for i, (b, c) in enumerate(zip(bias, v[3], strict=True))]
        assert x.step_biases is None and not any(bias) or np.allclose(x.step_biases, bias, atol=6e-5)


def test_model_path_repeats_its_last_step(spark):
    said = spark.createDataFrame([("a", T0.date(), [0.1, -0.1])], "symbol string, q_trading_date date, returns array<double>")
    q = spark.createDataFrame([("a", T0.date(), 10.0)], "symbol string, q_trading_date date, last_price double")
    got = [round(x.model, 9) for x in P.model_path(said, q, 4).orderBy("step").collect()]
    assert got == [11.0, 9.9, 9.9, 9.9]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two series of events, whole and cut at the 22nd day."""
    out = {}
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").where("event_type in ('click', 'view')")
    for name, d in {"whole": events, "cut": events.where("ts < '2024-01-22 06:00:00'")}.items():
        out[name] = str(tmp_path_factory.mktemp(name))
        d.coalesce(1).write.parquet(f"{out[name]}/events.parquet")
    return out


def test_forecasts_do_not_see_later_bars(spark, tables):
    """Cutting off all later events changes no forecast of an earlier day; forecasts follow the model and the biases."""
    got = {}
    for name, path in tables.items():
        f = forecast_queries.fc20_generate_forecast(spark, path).where("q_trading_date < '2024-01-20'")
        got[name] = {(x.symbol, x.q_trading_date, x.horizon): x for x in f.collect()}
    assert got["whole"].keys() == got["cut"].keys() and len(got["cut"]) >= 60
    for key, x in got["cut"].items():
        y = got["whole"][key]
        assert all(a == b or abs(a - b) < 1e-6 if isinstance(a, float) else a == b for a, b in zip(x, y, strict=True)), key
    assert sum(x.valid_count > 0 for x in got["cut"].values()) > 20


def test_score_without_a_limit_has_times(spark):
    bars = spark.createDataFrame([("a", T0 + i * HOUR, float(i)) for i in (0, 1, 3, 4)], "symbol string, bar_ts timestamp, close double")
    pred = spark.createDataFrame([("a", T0 + 2 * HOUR, None), ("a", T0 + 9 * HOUR, None)], "symbol string, target_time timestamp, actual_price double")
    got = {x.target_time: x for x in E.resolve_actuals(pred, bars, n=2, times=True).collect()}
    first, none = got[T0 + 2 * HOUR], got[T0 + 9 * HOUR]
    assert (first.actual_price, first.actual_ts, first.closes_ts, first.closes) == (3.0, T0 + 3 * HOUR, T0 + 4 * HOUR, [3.0, 4.0])
    assert none.actual_price is None and none.actual_ts is None
