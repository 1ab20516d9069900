"""Stateful streams: predictions that wait for their bar, and what a series has learned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barweave.operators import evaluation
from barweave.operators.forecast import next_advice
from barweave.operators.model import STEPS, Learner

#: States with timers, lists and initial rows are kept by this provider.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PREDICTION = {"base_price": "double", "predicted_price": "double", "lower_bound": "double", "upper_bound": "double", "predicted_direction": "string", "advice_type": "string"}
_NAMES = list(PREDICTION)


def _seconds(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds())


class Waiting(StatefulProcessor):
    """Predictions of one series and one span of target times, and the bars that may resolve them.

    A prediction is due at the first known bar from its target on, or, without one, when it has waited long enough.  It
    is settled when the watermark reaches that time, as no earlier bar can come then.
    """

    def __init__(self, wait_s: int):
        self.wait = wait_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", ", ".join(["target long", *(f"{k} {t}" for k, t in PREDICTION.items())]))
        self.bars = handle.getMapState("bars", "ts long", "close double")

    def _due(self, target: int, times: np.ndarray) -> int:
        k = np.searchsorted(times, target)
        return int(times[k]) if k < len(times) and times[k] <= target + self.wait else target + self.wait + 1

    def _settle(self, key: tuple, waiting: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Gives the predictions that are due; the others wait for their time."""
        bars = {k[0]: v[0] for k, v in self.bars.iterator()}
        times = np.array(sorted(bars), np.int64)
        due = [(self._due(p[0], times), p) for p in waiting]
        done = [(at, p) for at, p in due if at < 1000 * watermark_ms]
        if left := [x for x in due if x[0] >= 1000 * watermark_ms]:
            self.pending.put([p for _, p in left])
        else:
            self.pending.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if left:
            self.handle.registerTimer(min(at for at, _ in left) // 1000 + 1)
        elif len(times):  # what is kept for late predictions goes when none can come
            end = int(times[-1]) + 3 * self.wait
            if end < 1000 * watermark_ms:
                self.bars.clear()
            else:
                self.handle.registerTimer(end // 1000 + 1)
        if done:
            rows = pd.DataFrame([p for _, p in done], columns=["target_time", *_NAMES])
            found = [bars.get(at) if at <= p[0] + self.wait else None for at, p in done]
            rows["actual_price"] = pd.array(found, "Float64").to_numpy(float, na_value=np.nan)
            rows["actual_ts"] = pd.to_datetime(pd.Series([at if f is not None else None for (at, _), f in zip(done, found, strict=True)], dtype="Int64"), unit="us")
            rows["target_time"] = pd.to_datetime(rows["target_time"], unit="us")
            yield rows.assign(symbol=key[0])[["symbol", "target_time", *_NAMES, "actual_price", "actual_ts"]]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting = list(self.pending.get()) if self.pending.exists() else []
        for part in rows:
            told = part["target"].notna()
            for x in part[told][["target", *_NAMES]].itertuples(index=False):
                waiting.append((int(x[0]), *(float(v) for v in x[1:5]), x[5], x[6]))
            for ts, close in part[~told][["at", "close"]].itertuples(index=False):
                self.bars.updateValue((int(ts),), (float(close),))
        yield from self._settle(key, waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting = list(self.pending.get()) if self.pending.exists() else []
        yield from self._settle(key, waiting, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_evaluate(preds: DataFrame, bars: DataFrame, max_wait: str = "2 hours", lateness: str = "10 minutes", keyed: str = "1 day") -> DataFrame:
    """Each prediction once: with the close and time of the first bar from its target time to ``max_wait`` after it and its
    three flags, or with nulls when that time has passed without a bar.

    ``preds``: (symbol, created_at, target_time, base_price, predicted_price, lower_bound, upper_bound,
    predicted_direction, advice_type); ``bars``: (symbol, bar_ts, close).  State is keyed by the series and the
    span of length ``keyed`` that the target lies in, so that a series is many tasks; a bar goes to every span that it may
    resolve.  A row that comes later than ``lateness`` behind the latest one is dropped.
    """
    wait, width = _seconds(max_wait), _seconds(keyed)
    micros = lambda c: F.unix_micros(c)
    span = lambda seconds: F.floor(seconds / width).cast("long")
    nothing = [F.lit(None).cast(t).alias(k) for k, t in PREDICTION.items()]
    told = preds.select("symbol", F.col("created_at").alias("ts"), span(F.unix_seconds("target_time")).alias("span"), micros(F.col("target_time")).alias("target"), *[F.col(k).cast(t).alias(k) for k, t in PREDICTION.items()], F.lit(None).cast("long").alias("at"), F.lit(None).cast("double").alias("close"))
    at = F.unix_seconds("bar_ts")
    spans = F.sequence(span(at - wait), span(at))
    came = bars.select("symbol", F.col("bar_ts").alias("ts"), F.explode(spans).alias("span"), F.lit(None).cast("long").alias("target"), *nothing, micros(F.col("bar_ts")).alias("at"), F.col("close").cast("double").alias("close"))
    schema = ", ".join(["symbol string", "target_time timestamp", *(f"{k} {t}" for k, t in PREDICTION.items()), "actual_price double", "actual_ts timestamp"])
    both = told.union(came).withWatermark("ts", lateness).groupBy("symbol", "span")
    settled = both.transformWithStateInPandas(Waiting(wait), schema, "append", "eventTime")
    price = F.when(~F.isnan("actual_price"), F.col("actual_price"))
    settled = settled.withColumn("actual_price", price)
    return settled.withColumns({k: F.when(F.col("actual_price").isNotNull(), v) for k, v in evaluation.flags().items()})


#: What a series has learned: the last advice, step and extrema biases, and its model.
STATES = {
    "advice": "last string",
    "biases": "steps array<double>, high double, low double",
    "model": "weights array<double>, momentum array<double>, train_count int, ema_mse double, last_mse double",
}
INITIAL = "symbol string, last string, steps array<double>, high double, low double, weights array<double>, momentum array<double>, train_count int, ema_mse double, last_mse double"
LEARNED = "symbol string, ts timestamp, kind string, advice string, steps array<double>, high double, low double, train_count int, ema_mse double"
EVENT = {
    "advice_raw": "string", "upside": "double", "position": "double", "high_step": "int",
    "base_price": "double", "predicted_price": "double", "closes": "array<double>",
    "price": "double", "pred_high": "double", "pred_low": "double",
    "features": "array<double>", "returns": "array<double>",
}


def events(df: DataFrame, kind: str, ts: str = "ts") -> DataFrame:
    """Rows of one kind (advice, steps, extrema or sample) in the form that ``stream_state`` takes; what isn't there is null."""
    have = set(df.columns)
    value = lambda k, t: F.col(k).cast(t) if k in have else F.lit(None).cast(t)
    return df.select("symbol", F.col(ts).alias("ts"), F.lit(kind).alias("kind"), *[value(k, t).alias(k) for k, t in EVENT.items()])


class Memory(StatefulProcessor):
    """Advice, biases and model of one series, each a state of its own."""

    def __init__(self, seed: int, alpha: float, fast: float, slow: float, trigger: float):
        self.seed, self.alpha, self.fast, self.slow, self.trigger = seed, alpha, fast, slow, trigger

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = {k: handle.getValueState(k, v) for k, v in STATES.items()}

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        if row["last"] is not None:
            self.states["advice"].update((row["last"],))
        if row["steps"] is not None:
            self.states["biases"].update(([float(x) for x in row["steps"]], float(row["high"]), float(row["low"])))
        if row["weights"] is not None:
            self.states["model"].update(([float(x) for x in row["weights"]], [float(x) for x in row["momentum"]], int(row["train_count"]), float(row["ema_mse"]), float(row["last_mse"])))

    def _extreme(self, old: float, gap: float, beyond: bool, far: bool) -> float:
        if beyond:
            return self.fast * gap + self.slow * old
        return self.slow * gap * 0.1 + (1 - self.slow) * old if far else old

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        read = {k: s.get() if s.exists() else None for k, s in self.states.items()}
        last = read["advice"][0] if read["advice"] else "WAIT"
        steps, high, low = (list(read["biases"][0]), *read["biases"][1:]) if read["biases"] else ([0.0] * STEPS, 0.0, 0.0)
        model, changed = Learner(key[0], self.seed), set()
        if read["model"]:
            model.resume(dict(zip(("weights", "momentum", "train_count", "ema_mse", "last_mse"), read["model"], strict=True)))
        out = []
        for x in pd.concat(list(rows)).sort_values(["ts", "kind"], kind="stable").itertuples(index=False):  # one micro-batch of one series
            if x.kind == "advice":
                last = next_advice(last, x.advice_raw, x.upside, x.position, x.high_step)
                changed.add("advice")
            elif x.kind == "sample":
                model.learn(list(x.features), list(x.returns))
                changed.add("model")
            elif x.kind == "steps" and len(x.closes) == STEPS:
                first = x.base_price + (x.predicted_price - x.base_price) * 0.167
                path = [first + (x.predicted_price - first) * i / (STEPS - 1) for i in range(STEPS)]
                steps = [(1 - self.alpha) * b + self.alpha * (p - c) for b, p, c in zip(steps, path, x.closes, strict=True)]
                changed.add("biases")
            elif x.kind == "extrema":
                high = self._extreme(high, x.price - x.pred_high, x.price > x.pred_high, x.price < x.pred_high - self.trigger)
                low = self._extreme(low, x.price - x.pred_low, x.price < x.pred_low, x.price > x.pred_low + self.trigger)
                changed.add("biases")
            else:
                continue
            out.append((key[0], x.ts, x.kind, last, list(steps), high, low, model.count, model.ema))
        now = {"advice": (last,), "biases": (steps, high, low), "model": model.state()[1:]}
        for k in changed:
            self.states[k].update(now[k])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LEARNED.split(", ")])

    def close(self) -> None:
        pass


def stream_state(rows: DataFrame, initial: DataFrame | None = None, seed: int = 0, alpha: float = 0.25, fast: float = 0.3, slow: float = 0.7, trigger: float = 3.0) -> DataFrame:
    """For every row of ``events`` what its series has learned by then: advice, step and extrema biases (not rounded),
    training count and error of the model.

    Rows of a micro-batch are taken in time order; over batches they are taken as they come.  ``initial`` (columns of
    INITIAL) is what a new stream starts from, such as the result of a batch job; what is null there starts anew.  The
    states outlive restarts in the checkpoint, and ``read_state`` gives them.
    """
    memory = Memory(seed, alpha, fast, slow, trigger)
    first = None if initial is None else initial.select(*[c.split()[0] for c in INITIAL.split(", ")]).groupBy("symbol")
    return rows.groupBy("symbol").transformWithStateInPandas(memory, LEARNED, "append", "none", first)


def read_state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """(symbol, ...) rows of one of STATES as of the last batch of a stopped stream."""
    found = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    return found.select("key.symbol", "value.*")
