"""Structured Streaming jobs over ticks and predictions."""

from __future__ import annotations

import json
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from barweave.operators.cleaning import OHLC
from barweave.streaming.state import PROVIDER


def _start(writer, trigger: str | None) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)).start()


def _run_id(checkpoint: str, spark: SparkSession) -> str:
    """The id that Spark gives a checkpoint when its stream first starts; it stays over restarts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/metadata")
    with_id = spark.read.text(path.toString()).first()[0]
    return json.loads(with_id)["id"]


def stream_ingest(source: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("symbol", "bar_ts"), trigger: str | None = None) -> StreamingQuery:
    """Insert-or-ignore of every micro-batch into a parquet table: a key that exists, or came earlier, keeps its row.

    A batch's rows go to a folder named by the checkpoint's id and the batch's, and are written over when the batch is
    repeated: a restart adds nothing twice, and a new checkpoint over a table that exists leaves its rows alone.  Rows
    lie in month folders of the last key, and only the months of a batch are looked up.
    """
    spark, when = source.sparkSession, keys[-1]
    table = f"{path.rstrip('/')}"

    def write(batch: DataFrame, batch_id: int) -> None:
        own = f"run={_run_id(checkpoint, spark)}-{batch_id}"
        rest = [c for c in batch.columns if c not in keys]
        month = F.coalesce(F.date_format(when, "yyyy-MM"), F.lit("none"))
        fresh = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*rest)).alias("__r")).select(*keys, "__r.*").withColumn("month", month)
        months = [r[0] for r in batch.select(month.alias("month")).distinct().collect()]
        found = spark._jvm.org.apache.hadoop.fs.Path(table)
        files = found.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(found) and months:
            schema = T.StructType([*batch.schema.fields, T.StructField("run", T.StringType()), T.StructField("month", T.StringType())])
            old = spark.read.schema(schema).option("basePath", table).parquet(table).where(F.col("month").isin(months) & (F.col("run") != own[4:]))
            same = [old[k].eqNullSafe(fresh[k]) for k in keys]
            fresh = fresh.join(old.select(*keys, "month"), same, "left_anti")
        fresh.write.mode("overwrite").partitionBy("month").parquet(f"{table}/{own}")

    return _start(source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), trigger)


def stream_bars(ticks: DataFrame, width: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Bars of a tick stream; ticks that come late by up to ``lateness`` still count, a bar is emitted once when it is closed."""
    at = F.struct("ts", "event_id")
    d = ticks.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", width).alias("w"))
    d = d.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
    return d.select("symbol", F.col("w.start").alias("bar_ts"), *OHLC, "volume")


def stream_dedupe(stream: DataFrame, keys: list[str], lateness: str = "1 hour", ts: str = "ts") -> DataFrame:
    """One row for each key among rows within ``lateness`` of each other; state is dropped behind the watermark."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Appends a stream to a parquet table; the file sink commits each batch once.  States are kept by RocksDB."""
    conf = stream.sparkSession.conf
    setting, old = "spark.sql.streaming.stateStore.providerClass", conf.get("spark.sql.streaming.stateStore.providerClass")
    conf.set(setting, PROVIDER)
    try:  # a started stream has its own copy of the settings
        return _start(stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append"), trigger)
    finally:
        conf.set(setting, old)
