"""Stateful streams against batch jobs: each prediction once, stop and go on, initial rows, what the state store holds."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.operators import evaluation as E
from barweave.operators import forecast as P
from barweave.operators import model as L
from barweave.streaming import bars as S
from barweave.streaming import state as K

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)
PRED = "symbol string, created_at timestamp, target_time timestamp, base_price double, predicted_price double, lower_bound double, upper_bound double, predicted_direction string, advice_type string"




def test_each_prediction_is_settled_once(spark, tmp_path):
    """Bars and predictions come in turns, some bars late or missing: the stream gives what the batch job does."""
    r = random.Random(1)
    bars = [(s, T0 + i * HOUR, 50 + r.random()) for s in "ab" for i in range(60) if r.random() < 0.7 and not 20 < i < 27]
    preds = [(s, T0 + i * HOUR, T0 + (i + 3) * HOUR, 50 + r.random(), 50 + r.random(), 49.8, 50.6, r.choice(["UP", "DOWN", "FLAT"]), r.choice(["STRONG_BUY", "WAIT", "SELL_RISK"])) for s in "ab" for i in range(57)]
    times = [T0 + k * 12 * HOUR for k in range(6)]
    for k in range(5):
        spark.createDataFrame([b for b in bars if times[k] <= b[1] < times[k + 1]], "symbol string, bar_ts timestamp, close double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/bars")
        spark.createDataFrame([p for p in preds if times[k] <= p[1] < times[k + 1]], PRED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/preds")
        streams = [spark.readStream.schema(x).parquet(f"{tmp_path}/{n}") for n, x in (("preds", PRED), ("bars", "symbol string, bar_ts timestamp, close double"))]
        out = K.stream_evaluate(*streams, max_wait="2 hours", lateness="1 hour")
        S.run_to_table(out, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()  # stopped and started again after each part
    got = {(x.symbol, x.target_time): x for x in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()}
    assert len(got) == spark.read.parquet(f"{tmp_path}/out").count()
    seen = max(b[1] for b in bars) - HOUR
    batch = spark.createDataFrame(preds, PRED).withColumn("actual_price", F.lit(None).cast("double"))
    batch = E.resolve_actuals(batch, spark.createDataFrame(bars, "symbol string, bar_ts timestamp, close double"), times=True)
    scored = {(x.symbol, x.target_time): x for x in E.score_predictions(batch).collect() if x.actual_ts <= x.target_time + 2 * HOUR}
    for p in preds:
        key = (p[0], p[2])
        end = scored[key].actual_ts if key in scored else p[2] + 2 * HOUR
        assert (key in got) == (end < seen), key
        if key in got and key in scored:
            names = ("actual_price", "actual_ts", "is_direction_correct", "is_range_correct", "is_advice_correct")
            assert [got[key][n] for n in names] == [scored[key][n] for n in names]
        elif key in got:
            assert got[key].actual_price is None and got[key].actual_ts is None and got[key].is_range_correct is None
    assert sum(x.actual_price is None for x in got.values()) > 5 and len(got) > 80


def test_states_stop_restart_and_go_on(spark, tmp_path):
    """Advice, biases and model over four runs of one checkpoint, the first from initial rows, equal the batch jobs."""
    r, q = random.Random(2), np.random.default_rng(2)
    n = 40
    at = [T0 + i * HOUR for i in range(n)]
    series = [(s, t) for t in at for s in "ab"]
    advice = [(s, t, r.choice(P.ADVICE), 3 * r.random(), r.random(), r.randint(1, 30)) for s, t in series]
    steps = [(s, t, 50 + r.random(), 50 + r.random(), [50 + r.random() for _ in range(6)]) for s, t in series]
    extrema = [(s, t, 50 + 8 * r.random(), 54.0, 52.0) for s, t in series]
    samples = [(s, t, q.standard_normal(20).tolist(), (q.standard_normal(6) * 1e-3).tolist()) for s, t in series]
    tables = {
        "advice": spark.createDataFrame(advice, "symbol string, ts timestamp, advice_raw string, upside double, position double, high_step int"),
        "steps": spark.createDataFrame(steps, "symbol string, ts timestamp, base_price double, predicted_price double, closes array<double>"),
        "extrema": spark.createDataFrame(extrema, "symbol string, ts timestamp, price double, pred_high double, pred_low double"),
        "sample": spark.createDataFrame(samples, "symbol string, ts timestamp, features array<double>, returns array<double>"),
    }
    # the first ten hours are learned by batch jobs
    old = {k: d.where(F.col("ts") < F.lit(at[10])) for k, d in tables.items()}
    said = P.advice_state(old["advice"].withColumnRenamed("ts", "q_trading_date")).groupBy("symbol").agg(F.max_by("advice", "q_trading_date").alias("last"))
    gaps = E.extrema_bias(old["extrema"], order="ts").groupBy("symbol").agg(F.max_by("high_bias", "ts").alias("high"), F.max_by("low_bias", "ts").alias("low"))
    exact = {s: [0.0] * 6 for s in "ab"}
    for s, t, base, end, closes in steps:
        if t < at[10]:
            first = base + (end - base) * 0.167
            exact[s] = [0.75 * b + 0.25 * (first + (end - first) * i / 5 - c) for i, (b, c) in enumerate(zip(exact[s], closes, strict=True))]
    biases = spark.createDataFrame(list(exact.items()), "symbol string, steps array<double>")
    initial = said.join(biases, "symbol").join(gaps, "symbol").join(L.fit_online(old["sample"]), "symbol").persist()
    rows = None
    for k, d in tables.items():
        e = K.events(d.where(F.col("ts") >= F.lit(at[10])), k)
        rows = e if rows is None else rows.union(e)
    rows = rows.persist()
    for k in range(3):
        rows.where((F.col("ts") >= F.lit(at[10 + 10 * k])) & (F.col("ts") < F.lit(at[10] + (10 + 10 * k) * HOUR))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = K.stream_state(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), initial)
        S.run_to_table(out, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()
    assert len(got) == 4 * 2 * 30
    advised = {(x.symbol, x.q_trading_date): x.advice for x in P.advice_state(tables["advice"].withColumnRenamed("ts", "q_trading_date")).collect()}
    learned = {(x.symbol, x.target_time): x.biases for x in E.step_biases(tables["steps"].withColumnRenamed("ts", "target_time")).collect()}
    bounds = {(x.symbol, x.ts): (x.high_bias, x.low_bias) for x in E.extrema_bias(tables["extrema"], order="ts").collect()}
    for x in got:
        if x.kind == "advice":
            assert x.advice == advised[(x.symbol, x.ts)]
        elif x.kind == "steps":
            assert np.allclose(x.steps, learned[(x.symbol, x.ts)], atol=6e-5)
        elif x.kind == "extrema":
            assert np.allclose((x.high, x.low), bounds[(x.symbol, x.ts)])
    model = {x.symbol: x for x in L.fit_online(tables["sample"]).collect()}
    kept = {x.symbol: x for x in K.read_state(spark, f"{tmp_path}/cp", "model").collect()}
    assert kept.keys() == model.keys() == {"a", "b"}
    assert all(kept[s].train_count == n and np.allclose(kept[s].weights, model[s].weights) and np.isclose(kept[s].ema_mse, model[s].ema_mse) for s in "ab")
    assert {x["last"] for x in K.read_state(spark, f"{tmp_path}/cp", "advice").collect()} <= set(P.ADVICE)


@pytest.mark.parametrize("name", ["st4_stream_evaluate", "st5_stream_biases"])
def test_stream_queries_have_no_row_twice(spark, name):
    from barweave import registry

    registry.load()
    d = registry.QUERIES[name](spark, "/root/testdata/sf0.001").persist()
    keys = [c for c in ("symbol", "target_time", "ts", "step") if c in d.columns]
    assert d.count() > 500 and d.select(*keys).distinct().count() == d.count()
