"""Registered queries of the bar operators, and DuckDB SQL for those that SQL can express.

Query results are made comparable in one place: timestamps and dates become text, doubles are rounded to 6 digits.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("ingest_queries", "calendar_queries", "feature_queries", "match_queries", "forecast_queries", "learn_queries", "report_queries", "stream_queries")
FLAGSHIP = "ma14_match_days"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def presentable(df: DataFrame) -> DataFrame:
    shown = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            c = c.cast("string")
        elif kind in ("double", "float"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        shown.append(c.alias(name))
    return df.select(*shown)


def query(sql: str | None = None, doubles: str = "", times: str = "", longs: str = "") -> Callable[[Query], Query]:
    """Registers a query; ``doubles``, ``times`` and ``longs`` name columns of the SQL that are made comparable."""

    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return presentable(fn(spark, sf_dir))

        QUERIES[fn.__name__] = run
        if sql:
            shown = [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in doubles.split()]
            shown += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in times.split()]
            shown += [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]
            ORACLE_SQL[fn.__name__] = f"SELECT * REPLACE ({', '.join(shown)}) FROM ({sql})" if shown else sql
        return fn

    return register


def load() -> None:
    """Imports the modules that register queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"barweave.jobs.{name}")
