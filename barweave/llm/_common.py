"""Scratch tables, table access, word splitting and tokenizer access shared by the text operators."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Rows in one Arrow batch handed to Python: a few MB of ordinary documents.
ARROW_ROWS = "512"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``.  Where it is unset, a local session gets a temporary
    folder of its own; on a cluster, whose executors share no local folder, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the table read back: lineage ends there."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's setting by which the shuffle files of a query go when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables of one operator; a table is deleted once what reads it is written.  With ``tidy``, the shuffle files
    of a table go as soon as it is written."""

    def __init__(self, spark: SparkSession, tidy: bool = False):
        self.spark, self.paths, self.tidy = spark, {}, tidy

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written to the shared folder and read back."""
        path, before = scratch_path(self.spark, name), self.spark.conf.get(CLEANUP, None)
        if self.tidy:
            self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if self.tidy:
                self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = (kept, path)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads; others than its own are left alone."""
        for t in tables:
            _, path = self.paths.pop(id(t), (None, None))
            if path:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches small enough for very long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return df.mapInArrow(fn, schema)


def grouped(df: DataFrame, key: list[str], order: list[str], fn: Callable[[dict[str, list]], Iterable[tuple]], schema: str) -> DataFrame:
    """``fn`` over the rows of each key, which are few, in the order given; many keys share a task and none is a call of
    its own.  ``fn`` gets lists by column and gives rows."""
    names, out = df.columns, to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {n: [] for n in names}
        of, found = None, []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        for b in batches:
            columns = {n: b.column(i).to_pylist() for i, n in enumerate(names)}
            keys = list(zip(*(columns[k] for k in key), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if of not in (None, keys[i]):
                    found += fn(held)
                    held = {n: [] for n in names}
                of = keys[i]
                for n in names:
                    held[n] += columns[n][i:j]
            if found:
                yield batch(found)
                found = []
        if of is not None and (found := list(fn(held))):
            yield batch(found)

    return map_arrow(df.repartition(*key).sortWithinPartitions(*key, *order), run, schema)


def numbered(rows: DataFrame, scratch: Scratch, order: list[str], tree: str = "tree", flag: str | None = None) -> DataFrame:
    """Adds pos (from 0, in the order given) and n (rows) within each value of ``tree``, and the number of earlier rows
    with ``flag`` as flagged.  Rows are range-partitioned, so that one value may lie over many tasks; only counts of
    (value, range) are summed up in order."""
    ranged = scratch.keep(rows.repartitionByRange(tree, *order).withColumn("part", F.spark_partition_id()), "ranged")
    held = F.lit(0) if flag is None else F.when(F.col(flag), 1).otherwise(0)
    counts = ranged.groupBy(tree, "part").agg(F.count("*").alias("m"), F.sum(held).alias("f"))
    of = W.partitionBy(tree)
    run = of.orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    counts = counts.select(tree, "part", (F.sum("m").over(run) - F.col("m")).alias("before"), F.sum("m").over(of).alias("n"), (F.sum("f").over(run) - F.col("f")).alias("f_before"))
    own = W.partitionBy(tree, "part").orderBy(*order)
    d = ranged.withColumn("local", F.row_number().over(own) - 1)
    if flag is not None:
        d = d.withColumn("f_local", F.sum(held).over(own.rowsBetween(W.unboundedPreceding, 0)) - held)
    d = d.join(if_small(scratch.keep(counts, "ranges")), [tree, "part"]).withColumn("pos", F.col("before") + F.col("local"))
    if flag is not None:
        d = d.withColumn("flagged", F.col("f_before") + F.col("f_local"))
    return d.drop("part", "local", "before", "f_before", "f_local")


# Bytes of words: digits, letters (A-Z lowered) and everything beyond ASCII. Other bytes separate.
_ALNUM = bytes(
    (b + 32) if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters of a UTF-8 text."""
    return text.translate(_ALNUM).split() if text else []


def spaced_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space of a UTF-8 text, A-Z lowered."""
    return text.lower().split() if text else []


def utf8(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


#: A written table of so many rows of a few numbers each may be broadcast (some tens of MB).
BROADCAST_ROWS = 500_000


def if_small(written: DataFrame) -> DataFrame:
    """Marks a written table of a few numeric columns for broadcast if it is counted to be small; else it is joined by
    a shuffle."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written
