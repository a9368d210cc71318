"""Query registry: every operator exposed as ``(spark, sf_dir) -> DataFrame``
plus, where the semantics are set-based, an equivalent DuckDB SQL text.

Outputs are normalised for comparison only: doubles rounded to 6 decimals
(both engines sum floating point in different orders), integers widened to
BIGINT. The operators themselves do not round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def finalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(f.name)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint").alias(f.name)
        elif isinstance(f.dataType, T.DecimalType):
            c = (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finalize(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def rnd(expr: str, alias: str) -> str:
    """Oracle-side twin of ``finalize`` for one double column."""
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {alias}"


def select_sql(ctes: str, source: str, cols: list[tuple[str, str]]) -> str:
    """``WITH ctes SELECT <cols> FROM source``; cols = (name, kind) with kind
    in {'d' double, 'i' bigint, 's' as-is}."""
    out = []
    for name, kind in cols:
        if kind == "d":
            out.append(rnd(name, name))
        elif kind == "i":
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        else:
            out.append(name)
    return f"WITH {ctes}\nSELECT {', '.join(out)} FROM {source}"
