"""Reading, writing, merging and reshaping bar, prediction and state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_KEY = ("symbol", "bar_ts")


def prefer_source(df: DataFrame, source: str | None) -> DataFrame:
    """Rows of one source; a series without any keeps all its rows."""
    if source is None:
        return df
    has = df.groupBy("symbol").agg(F.max(F.coalesce(F.col("source") == source, F.lit(False))).alias("__has"))
    return df.join(has, "symbol").where(~F.col("__has") | (F.col("source") == source)).drop("__has")


def read_bars(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Bars of a parquet table; readers order them by (symbol, bar_ts) themselves."""
    return prefer_source(spark.read.parquet(path), source)


def purge_other_sources(df: DataFrame, source: str) -> DataFrame:
    return df.where(F.col("source") == source)


def append_new_bars(existing: DataFrame, batch: DataFrame, keys: tuple[str, ...] = BAR_KEY, order: str | None = None) -> DataFrame:
    """Insert-or-ignore: a key that exists keeps its row; of a batch's rows the first by ``order`` is taken.

    Only the columns of ``existing`` are read; a null volume becomes 0.
    """
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*([order] if order else [c for c in existing.columns if c not in keys])))
    fresh = batch.withColumn("__n", first).where("__n = 1").select(*existing.columns)
    if "volume" in existing.columns:
        fresh = fresh.withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    return existing.unionByName(fresh.join(existing.select(*keys), list(keys), "left_anti"))


def upsert_latest(existing: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert-or-replace: the row with the largest ``order`` stays; the batch wins ties."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)))
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order), F.desc("__new")))
    return both.withColumn("__n", last).where("__n = 1").drop("__n", "__new")


def full_reload(df: DataFrame, path: str, by: str = "month", ts: str = "bar_ts") -> None:
    """Clears the table and writes it again, one folder a month."""
    df.withColumn(by, F.date_format(ts, "yyyy-MM")).write.mode("overwrite").partitionBy(by).parquet(path)


def write_snapshot(df: DataFrame, path: str, ts: str = "bar_ts") -> None:
    """Parquet by month, sorted by series and time inside files, so that scans prune by month and row group."""
    month = df.withColumn("month", F.date_format(ts, "yyyy-MM"))
    month.repartition("month", "symbol").sortWithinPartitions("symbol", ts).write.mode("overwrite").partitionBy("month").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("month")


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Adds absent columns as typed nulls."""
    have = set(df.columns)
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in have])


def state_to_json(df: DataFrame, cols: list[str], digits: int = 8) -> DataFrame:
    """Arrays of doubles as JSON text, rounded."""
    return df.withColumns({c: F.to_json(F.transform(c, lambda x: F.round(x, digits))) for c in cols})


def state_from_json(df: DataFrame, col: str) -> DataFrame:
    """Adds (scalar, vector): a JSON array becomes the vector, a number the scalar, anything else nulls."""
    is_array = F.startswith(F.trim(col), F.lit("["))
    vector = F.when(is_array, F.from_json(F.col(col), "array<double>"))
    return df.withColumns({"scalar": F.when(~is_array, F.expr(f"try_cast(`{col}` AS double)")), "vector": vector})


def kv_to_matrix(kv: DataFrame, prefix: str, n_cols: int, n_rows: int) -> DataFrame:
    """Flat weights ``prefix_<i>`` as (symbol, row, values): i is row * n_cols + column; cells outside are dropped."""
    i = F.regexp_extract("key", f"^{prefix}_(\\d+)$", 1)
    cells = kv.where(i != "").select("symbol", i.cast("int").alias("i"), F.expr("try_cast(value AS double)").alias("v"))
    cells = cells.where(F.col("i") < n_cols * n_rows).select("symbol", F.floor(F.col("i") / n_cols).alias("row"), (F.col("i") % n_cols).alias("col"), "v")
    return cells.groupBy("symbol", "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "v"))), lambda x: x["v"]).alias("values"))


def drop_state_keys(kv: DataFrame, like: str, keep: str) -> DataFrame:
    return kv.where(~(F.col("key").like(like) & (F.col("key") != keep)))
