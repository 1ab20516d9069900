"""Windows over long series: positions, chunks with a halo of neighbouring rows, carried values, affine recurrences.

A series of millions of rows in one window would be one task.  Rows get a position in two levels (counts of months,
then row numbers inside a month); chunks are runs of positions, and every chunk also gets the rows just before and
after it, so that a framed function gives the same as over the whole series.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a chunk without its halo, and chunks (and blocks of chunks) whose maps are composed to one.
CHUNK, FAN = 4096, 256


def series(*by: str, order: str = "bar_ts") -> W:
    """The plain window of a series, for tables that are short for each key."""
    return W.partitionBy(*(by or ("symbol",))).orderBy(order)


def month(order: str, unit: str = "month") -> Column:
    """The month (or day, ...) that a row is filed under; rows without a time have one of their own, before all others."""
    return F.coalesce(F.date_trunc(unit, order), F.lit("0001-01-01").cast("timestamp"))


def with_position(df: DataFrame, by: tuple[str, ...] = ("symbol",), order: str = "bar_ts") -> DataFrame:
    """Adds ``pos``, the 0-based position in the series, without a window over a whole series.  Rows without a time come
    first."""
    d = df.withColumn("__month", month(order))
    counts = d.groupBy(*by, "__month").agg(F.count("*").alias("__n"))
    earlier = W.partitionBy(*by).orderBy("__month").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*by, "__month", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    inside = F.row_number().over(W.partitionBy(*by, "__month").orderBy(order))
    return d.withColumn("__row", inside).join(starts, [*by, "__month"]).withColumn("pos", F.col("__start") + F.col("__row") - 1).drop("__month", "__row", "__start")


def in_chunks(df: DataFrame, transform: Callable[[DataFrame, W], DataFrame], behind: int, ahead: int = 0, by: tuple[str, ...] = ("symbol",), order: str = "bar_ts", chunk: int = CHUNK, positioned: bool = False) -> DataFrame:
    """``transform(rows, window)`` chunk by chunk, with ``behind`` rows before each chunk and ``ahead`` after it.

    Rows of the halo are dropped again.  ``chunk`` must not be smaller than the halo.  With ``positioned``, ``df`` has
    its positions already.
    """
    chunk = max(chunk, behind, ahead)
    d = df if positioned else with_position(df, by, order)
    own, within = F.floor(F.col("pos") / chunk), F.col("pos") % chunk
    copies = F.array(own, F.when(within >= chunk - behind, own + 1), F.when((within < ahead) & (own > 0), own - 1))
    d = d.withColumn("__chunk", F.explode(F.array_compact(copies)))
    w = W.partitionBy(*by, "__chunk").orderBy("pos")
    return transform(d, w).where(F.col("__chunk") == F.floor(F.col("pos") / chunk)).drop("__chunk")


def running_sums(df: DataFrame, sums: dict[str, str], by: tuple[str, ...] = ("symbol",), order: str = "bar_ts") -> DataFrame:
    """Adds, under each name, the sum of a column up to each row of a series: inside months, and of the months before."""
    d = df.withColumn("__month", month(order))
    totals = d.groupBy(*by, "__month").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = W.partitionBy(*by).orderBy("__month").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*by, "__month", *[F.coalesce(F.sum(n).over(earlier), F.lit(0.0)).alias(f"__{n}") for n in sums])
    inside = W.partitionBy(*by, "__month").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    d = d.select("*", *[F.sum(c).over(inside).alias(f"__in_{n}") for n, c in sums.items()]).join(starts, [*by, "__month"])
    return d.select(*df.columns, *[(F.col(f"__{n}") + F.col(f"__in_{n}")).alias(n) for n in sums])


def fill(df: DataFrame, cols: list[str], forward: bool = True, by: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    """Carries the last (or next) non-null value of each column along a series.

    Filling runs inside months; each month's last value travels on a small table of months.
    """
    d = df.withColumn("__month", month(order))
    pick = F.last if forward else F.first
    inside = W.partitionBy(*by, "__month").orderBy(order)
    inside = inside.rowsBetween(W.unboundedPreceding, 0) if forward else inside.rowsBetween(0, W.unboundedFollowing)
    key = F.col(order)
    ends = d.groupBy(*by, "__month").agg(*[(F.max_by if forward else F.min_by)(c, F.when(F.col(c).isNotNull(), key)).alias(c) for c in cols])
    months = W.partitionBy(*by).orderBy("__month")
    months = months.rowsBetween(W.unboundedPreceding, -1) if forward else months.rowsBetween(1, W.unboundedFollowing)
    carried = ends.select(*by, "__month", *[pick(c, ignorenulls=True).over(months).alias(f"__{c}") for c in cols])
    filled = d.select("*", *[pick(c, ignorenulls=True).over(inside).alias(f"__in_{c}") for c in cols]).join(carried, [*by, "__month"])
    out = [F.coalesce(f"__in_{c}", f"__{c}").alias(c) if c in cols else F.col(c) for c in df.columns]
    return filled.select(*out)


def decayed_sum(value: Column, keep: float, w: W, pos: Column) -> Column:
    """Sum of ``value * keep ** age`` over a chunk's rows so far; ages are kept small by the chunk's length."""
    return F.sum(value * F.pow(F.lit(1 / keep), pos)).over(w.rowsBetween(W.unboundedPreceding, 0)) * F.pow(F.lit(keep), pos)


def decay_chunk(keep: float) -> tuple[int, int]:
    """Rows after which a decayed term is below double precision, and a chunk length that can't overflow."""
    halo = math.ceil(math.log(1e-18) / math.log(keep))
    return halo, max(halo, int(250 / math.log10(1 / keep)) - halo)


def carried(maps: DataFrame, f: str, compose: Callable[[Column, Column], Column], step: Callable[[Column, Column], Column], start: Column, by: tuple[str, ...] = ("symbol",), fan: int = FAN) -> DataFrame:
    """(by, __chunk, __x): what each chunk of a series starts from, given the map ``f`` of every chunk.

    Maps of ``fan`` chunks are composed to one of a block, and those of ``fan`` blocks again; starts are then handed
    down, so that no row ever gathers more than ``fan`` maps, but for a series' blocks of blocks (of fan * fan chunks).
    ``compose(earlier, later)`` is one map after another, ``step(x, map)`` is where a map leads.
    """
    d = maps.select(*by, "__chunk", F.col(f).alias("__f"))
    d = d.withColumns({"__block": F.floor(F.col("__chunk") / fan).cast("long"), "__top": F.floor(F.col("__chunk") / fan**2).cast("long")})

    def joined(rows: DataFrame, own: str, *above: str) -> DataFrame:
        each = F.transform(F.sort_array(F.collect_list(F.struct(own, "__f"))), lambda r: r["__f"])
        whole = F.aggregate(F.slice(each, 2, F.size(each)), F.get(each, F.lit(0)), compose)
        return rows.groupBy(*by, *above).agg(whole.alias("__f"))

    def starts(rows: DataFrame, own: str, *above: str) -> DataFrame:
        earlier = W.partitionBy(*by, *above).orderBy(own).rowsBetween(W.unboundedPreceding, -1)
        x = F.aggregate(F.collect_list("__f").over(earlier), F.col("__x") if above else start, step)
        return rows.withColumn("__s", x).select(*by, own, F.col("__s").alias("__x"))

    blocks = joined(d, "__chunk", "__block", "__top")
    tops = starts(joined(blocks, "__block", "__top"), "__top")
    blocks = starts(blocks.join(tops, [*by, "__top"]), "__block", "__top")
    return starts(d.join(blocks, [*by, "__block"]), "__chunk", "__block")


def affine_scans(df: DataFrame, pairs: dict[str, tuple[str, str]], start: float = 0.0, by: tuple[str, ...] = ("symbol",), order: str = "ts", chunk: int = CHUNK) -> DataFrame:
    """Adds, under each name, x after each row of the recurrence x <- a * x + b along a series; ``pairs`` names a and b.

    Each chunk is composed to one (a, b) for every recurrence, ``carried`` gives each chunk its starts, and every chunk
    is then expanded from its own; so a long series is many tasks.
    """
    d = with_position(df, by, order).withColumn("__chunk", F.floor(F.col("pos") / chunk).cast("long"))
    keys, n = [*by, "__chunk"], len(pairs)
    number = lambda names: F.array(*[F.col(c).cast("double") for c in names])
    each = F.struct("pos", number([a for a, _ in pairs.values()]).alias("a"), number([b for _, b in pairs.values()]).alias("b"))
    places = F.sequence(F.lit(0), F.lit(n - 1))
    one = F.struct(F.array_repeat(F.lit(1.0), n).alias("a"), F.array_repeat(F.lit(0.0), n).alias("b"))
    compose = lambda s, r: F.struct(F.transform(places, lambda i: F.get(r["a"], i) * F.get(s["a"], i)).alias("a"), F.transform(places, lambda i: F.get(r["a"], i) * F.get(s["b"], i) + F.get(r["b"], i)).alias("b"))
    step = lambda x, f: F.transform(places, lambda i: F.get(f["a"], i) * F.get(x, i) + F.get(f["b"], i))
    chunks = d.groupBy(*keys).agg(F.aggregate(F.sort_array(F.collect_list(each)), one, compose).alias("f"))
    started = d.join(carried(chunks, "f", compose, step, F.array_repeat(F.lit(float(start)), n), by), keys)
    schema = started.drop("__chunk", "__x").withColumns({out: F.lit(0.0) for out in pairs}).schema

    def expand(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        x, values = np.array(rows["__x"].iloc[0], float), np.empty((len(rows), n))
        p, q = (rows[[ab[k] for ab in pairs.values()]].to_numpy(float) for k in (0, 1))
        for i in range(len(rows)):
            x = p[i] * x + q[i]
            values[i] = x
        return rows.drop(columns=["__chunk", "__x"]).assign(**{out: values[:, k] for k, out in enumerate(pairs)})

    return started.groupBy(*keys).applyInPandas(expand, schema).drop("pos")


def affine_scan(df: DataFrame, a: str, b: str, out: str, start: float = 0.0, by: tuple[str, ...] = ("symbol",), order: str = "ts", chunk: int = CHUNK) -> DataFrame:
    """One recurrence, see ``affine_scans``."""
    return affine_scans(df, {out: (a, b)}, start, by, order, chunk)
