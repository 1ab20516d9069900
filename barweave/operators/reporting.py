"""Tables for display: timeline, maps of past predictions, summary and trend card."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barweave import config
from barweave.functions.columns import rounded
from barweave.operators import calendar


def timeline(bars: DataFrame, forecast: DataFrame, preds: DataFrame, n: int = config.WINDOW, steps: int = config.FUTURE_STEPS, width: str = config.BAR, top1: DataFrame | None = None, tracks: DataFrame | None = None) -> DataFrame:
    """One axis of the last ``n`` bars and ``steps`` future points: (symbol, ts, label, real, predicted, upper, lower,
    hist_pred, advice_type).

    ``forecast``: (symbol, step, predicted, upper, lower); its lines start at the last real price.  ``preds``: (symbol, ts,
    price, advice_type).  Points without advice say WAIT.

    ``top1``: (symbol, top1_track), prices that end at the last future point; earlier points than it has are null, more than
    the axis has are cut at its start.  ``tracks``: (symbol, tracks) as ``forecast.history_tracks`` gives them; each point
    after the last real one has (rank, price) of every track, the last real one its price, earlier ones null.
    """
    past = calendar.axis_labels(calendar.tail(bars, n)).select("symbol", F.col("bar_ts").alias("ts"), "label", rounded("close", 2).alias("real"), F.lit(None).cast("int").alias("step"))
    last = past.groupBy("symbol").agg(F.max("ts").alias("__last"))
    future = calendar.future_axis(bars, steps, width).select("symbol", "ts", "label", F.lit(None).cast("double").alias("real"), "step")
    axis = past.unionByName(future).join(last, "symbol")
    d = axis.join(forecast, ["symbol", "step"], "left").join(preds.select("symbol", "ts", F.col("price").alias("hist_pred"), "advice_type"), ["symbol", "ts"], "left")
    line = lambda c: F.when(F.col("ts") == F.col("__last"), F.col("real")).otherwise(F.col(c)).alias(c)
    more = []
    if top1 is not None:
        back = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts"))) - 1  # n + steps points for each series
        d = d.withColumn("__back", back).join(top1.select("symbol", F.reverse("top1_track").alias("__top1")), "symbol", "left")
        more.append(F.get("__top1", F.col("__back")).alias("top1"))
    if tracks is not None:
        d = d.join(tracks.select("symbol", F.col("tracks").alias("__tracks")), "symbol", "left")
        price = lambda t: F.when(F.col("step").isNull(), F.col("real")).otherwise(F.get(t["path"], F.col("step") - 1))
        points = F.transform("__tracks", lambda t: F.struct(t["rank"].alias("rank"), price(t).alias("price")))
        more.append(F.when(F.col("ts") >= F.col("__last"), points).alias("tracks"))
    return d.select("symbol", "ts", "label", "real", line("predicted"), line("upper"), line("lower"), "hist_pred", F.coalesce("advice_type", F.lit("WAIT")).alias("advice_type"), *more)


def prediction_maps(preds: DataFrame) -> DataFrame:
    """(symbol, ts, price, advice_type): the latest predicted price of each target time, and the latest advice whose creation
    or target time it is."""
    price = preds.groupBy("symbol", F.col("target_time").alias("ts")).agg(F.max_by("predicted_price", "created_at").alias("price"))
    either = preds.select("symbol", F.explode(F.array("created_at", "target_time")).alias("ts"), "created_at", "advice_type").where("advice_type is not null")
    advice = either.groupBy("symbol", "ts").agg(F.max_by("advice_type", "created_at").alias("advice_type"))
    return price.join(advice, ["symbol", "ts"], "full")


def summary_metrics(forecasts: DataFrame, evaluation: DataFrame) -> DataFrame:
    """One flat row for each series, rounded, with defaults where nothing is known yet."""
    d = forecasts.join(evaluation, "symbol", "left")
    return d.select("symbol", rounded("last_price", 2).alias("last_price"), F.coalesce(rounded("win_rate", 1), F.lit(100.0)).alias("win_rate"), F.coalesce(rounded("mape", 4), F.lit(0.0)).alias("mape"), F.coalesce("n", F.lit(0)).alias("n"))


def trend_card(d: DataFrame, flat: float = 0.05) -> DataFrame:
    """Adds change, change_pct and trend of target_price against last_price."""
    change = F.col("target_price") - F.col("last_price")
    pct = F.when(F.col("last_price") != 0, change / F.col("last_price") * 100).otherwise(0.0)
    return d.withColumns({"change": rounded(change, 2), "change_pct": rounded(pct, 2), "trend": F.when(change > flat, "up").when(change < -flat, "down").otherwise("flat")})
