"""A small network of 20 inputs, 16 tanh units and 6 outputs for each series, learned online in time order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave import config
from barweave.functions.columns import clip, rounded

INPUTS, HIDDEN, STEPS = 20, 16, config.FUTURE_STEPS
SIZES = (INPUTS * HIDDEN, HIDDEN, HIDDEN * STEPS, STEPS)
STATE = "symbol string, weights array<double>, momentum array<double>, train_count int, ema_mse double, last_mse double"


def initial_weights(symbol: str, seed: int = 0) -> np.ndarray:
    """All weights of a series in one row; the random ones depend on its name and the seed alone."""
    r = np.random.default_rng([seed, zlib.crc32(symbol.encode())])
    w1 = r.standard_normal(SIZES[0]) * np.sqrt(2.0 / INPUTS)
    w2 = r.standard_normal(SIZES[2]) * 0.001
    return np.concatenate([w1, np.zeros(HIDDEN), w2, np.zeros(STEPS)])


def unpack(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a, b, c = np.cumsum(SIZES)[:3]
    return flat[:a].reshape(INPUTS, HIDDEN), flat[a:b], flat[b:c].reshape(HIDDEN, STEPS), flat[c:]


def fixed_inputs(x: np.ndarray) -> np.ndarray:
    """Rows cut or padded with zeros to the number of inputs."""
    return np.pad(x, ((0, 0), (0, max(0, INPUTS - x.shape[1]))))[:, :INPUTS]


def model_predict(features: DataFrame, state: DataFrame, price: str = "last_price", most: float = 0.0008) -> DataFrame:
    """Adds returns (limited by 0.0003 + 1e-5 for each training step, ``most`` at most) and the compounded price path.

    Model rows meet their series by a join; each Arrow batch is one matrix product for every model in it.
    """

    @F.pandas_udf("array<double>")
    def forward(x: pd.Series, weights: pd.Series, count: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), dtype=object)
        which = weights.map(lambda w: np.asarray(w).tobytes())
        for key, at in which.groupby(which).groups.items():
            w1, b1, w2, b2 = unpack(np.frombuffer(key))
            rows = fixed_inputs(np.stack([np.pad(np.asarray(v, float)[:INPUTS], (0, max(0, INPUTS - len(v)))) for v in x.loc[at]]))
            y = np.tanh(rows @ w1 + b1) @ w2 + b2
            bound = np.minimum(0.0003 + count.loc[at].to_numpy() * 1e-5, most)[:, None]
            for i, r in zip(at, np.clip(y, -bound, bound), strict=True):
                out[i] = r.tolist()
        return out

    d = features.join(state.select("symbol", "weights", "train_count"), "symbol")
    d = d.withColumn("returns", forward("features", "weights", "train_count")).drop("weights", "train_count")
    path = F.aggregate("returns", F.array().cast("array<double>"), lambda a, r: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.col(price)) * (1 + r))))
    return d.withColumn("path", path)


def sgd_step(flat: np.ndarray, velocity: np.ndarray, count: int, x: np.ndarray, y: np.ndarray, rate: float = 0.01, l2: float = 1e-3, decay: float = 0.995, momentum: float = 0.9, limit: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """One observation: forget a little, go back through the tanh layer, limit the gradient's norm, move with momentum."""
    a, b, c = np.cumsum(SIZES)[:3]
    flat = flat.copy()
    flat[:a] *= decay
    flat[b:c] *= decay
    w1, b1, w2, b2 = unpack(flat)
    h = np.tanh(x @ w1 + b1)
    err = h @ w2 + b2 - y
    back = (w2 @ err) * (1 - h * h)
    grad = np.concatenate([(np.outer(x, back) + l2 * w1).ravel(), back, (np.outer(h, err) + l2 * w2).ravel(), err])
    norm = np.sqrt((grad * grad).sum() + 1e-12)
    if norm > limit:
        grad *= limit / norm
    velocity = momentum * velocity - rate / np.sqrt(count + 2) * grad
    return flat + velocity, velocity, float((err * err).mean())


class Learner:
    """The model of one series while its samples pass by: a few hundred numbers."""

    def __init__(self, symbol: str, seed: int):
        self.symbol, self.count, self.ema, self.last = symbol, 0, 0.0, 0.0
        self.flat = initial_weights(symbol, seed)
        self.velocity = np.zeros_like(self.flat)

    def resume(self, row: dict) -> None:
        self.flat, self.velocity = np.array(row["weights"], float), np.array(row["momentum"], float)
        self.count, self.ema, self.last = row["train_count"], row["ema_mse"], row["last_mse"]

    def learn(self, x: list[float], y: list[float]) -> None:
        self.flat, self.velocity, self.last = sgd_step(self.flat, self.velocity, self.count, fixed_inputs(np.asarray(x, float)[None])[0], np.asarray(y, float))
        self.count += 1
        self.ema = self.last if self.ema == 0.0 else 0.8 * self.ema + 0.2 * self.last

    def returns(self, x: list[float], most: float) -> list[float]:
        w1, b1, w2, b2 = unpack(self.flat)
        y = np.tanh(fixed_inputs(np.asarray(x, float)[None])[0] @ w1 + b1) @ w2 + b2
        bound = min(0.0003 + self.count * 1e-5, most)
        return np.clip(y, -bound, bound).tolist()

    def state(self) -> tuple:
        return self.symbol, self.flat.tolist(), self.velocity.tolist(), self.count, self.ema, self.last


#: What a row of a series is, in the order in which rows of one time are taken.
RESUMED, SAMPLE, ASKED = 0, 1, 2
NAMES = [c.split()[0] for c in STATE.split(", ")]


def _taken_in_order(samples: DataFrame, state: DataFrame | None, order: str) -> DataFrame:
    """Known model rows and samples as rows of one kind, to be sorted by ``in_order``."""
    blank = [F.lit(None).cast(t.split(" ", 1)[1]).alias(t.split()[0]) for t in STATE.split(", ")[1:]]
    rows = samples.select("symbol", F.lit(SAMPLE).alias("kind"), F.col(order).cast("timestamp").alias("t"), F.col("features").cast("array<double>").alias("features"), F.col("returns").cast("array<double>").alias("returns"), *blank)
    if state is not None:
        nothing = [F.lit(None).cast("timestamp").alias("t"), F.lit(None).cast("array<double>").alias("features"), F.lit(None).cast("array<double>").alias("returns")]
        rows = rows.union(state.select("symbol", F.lit(RESUMED).alias("kind"), *nothing, *NAMES[1:]))
    return rows


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("symbol").sortWithinPartitions("symbol", F.col("kind") != RESUMED, "t", "kind", "features", "returns")


def fit_online(samples: DataFrame, state: DataFrame | None = None, order: str = "ts", seed: int = 0) -> DataFrame:
    """Model rows after learning each series' (features, returns) in time order; series are independent tasks.

    Samples are sorted by Spark and come in Arrow batches; a series goes on from batch to batch with its model alone, so
    memory doesn't grow with its length.  Samples of one time are ordered by their numbers.  Series without new samples
    keep their row; an empty table of samples gives the known rows.
    """
    rows = _sorted(_taken_in_order(samples, state, order))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: Learner | None = None

        def batch(done: list[Learner]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32(), pa.float64(), pa.float64()]
            return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*(x.state() for x in done), strict=True), kinds, strict=True)], NAMES)

        for b in batches:
            done = []
            for row in pa.table([*b.columns], names).to_pylist():
                if of is None or of.symbol != row["symbol"]:
                    done += [of] if of else []
                    of = Learner(row["symbol"], seed)
                if row["kind"] == RESUMED:
                    of.resume(row)
                else:
                    of.learn(row["features"], row["returns"])
            if done:
                yield batch(done)
        if of is not None:
            yield batch([of])

    return rows.mapInArrow(run, STATE)


def replay(samples: DataFrame, queries: DataFrame, state: DataFrame | None = None, order: str = "ts", seed: int = 0, most: float = 0.0008) -> DataFrame:
    """(symbol, key, returns, mse, train_count) for (symbol, key, ts, features) queries: what the model that has learned the
    samples up to a query's time, and none after it, says of the query.  Without features there are no returns.

    Samples and queries of a series pass through one task in time order, as in ``fit_online``.
    """
    rows = _taken_in_order(samples, state, order).withColumn("key", F.lit(None).cast("string"))
    nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("returns", *NAMES[1:])]
    asked = queries.select("symbol", F.lit(ASKED).alias("kind"), F.col("ts").cast("timestamp").alias("t"), F.col("features").cast("array<double>").alias("features"), *nothing, "key")
    rows = _sorted(rows.union(asked))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: Learner | None = None
        for b in batches:
            said = []
            for row in pa.table([*b.columns], names).to_pylist():
                if of is None or of.symbol != row["symbol"]:
                    of = Learner(row["symbol"], seed)
                if row["kind"] == RESUMED:
                    of.resume(row)
                elif row["kind"] == SAMPLE:
                    of.learn(row["features"], row["returns"])
                else:
                    x = row["features"]
                    said.append((of.symbol, row["key"], None if x is None else of.returns(x, most), of.ema, of.count))
            if said:
                kinds = [pa.string(), pa.string(), pa.list_(pa.float64()), pa.float64(), pa.int32()]
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*said, strict=True), kinds, strict=True)], ["symbol", "key", "returns", "mse", "train_count"])

    return rows.mapInArrow(run, "symbol string, key string, returns array<double>, mse double, train_count int")


def model_status(state: DataFrame) -> DataFrame:
    """(symbol, train_count, last_mse, ensemble_weight): 10 to 50 percent by quality, from 5 observations on."""
    quality = clip(1 - F.col("ema_mse") / config.MSE_BASE, 0.0, 1.0)
    ready: Column = (F.col("train_count") >= 5) & (F.col("ema_mse") > 0)
    last = F.when(F.col("last_mse") > 0, F.col("last_mse")).otherwise(F.col("ema_mse"))
    return state.select("symbol", "train_count", rounded(last, 8).alias("last_mse"), F.when(ready, F.bround(10 + 40 * quality)).otherwise(10).cast("int").alias("ensemble_weight"))
