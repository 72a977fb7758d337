"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def _tidy(df: DataFrame, digits: int) -> DataFrame:
    """Round doubles and widen integers, so both engines print values alike."""
    def fix(f: T.StructField) -> str:
        c = f"`{f.name}`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return f"round(double({c}), {digits}) + 0.0D AS {c}"
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return f"bigint({c}) AS {c}"
        return c
    return df.selectExpr(*[fix(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None, doubles: str = "", longs: str = "", digits: int = DIGITS):
    """Register ``f(spark, sf_dir)``. ``doubles`` and ``longs`` name the numeric columns of the
    SQL result, which get the same rounding and width."""
    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _tidy(f(spark, sf_dir), digits)
        if sql is not None:
            fixes = [f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in doubles.split()]
            fixes += [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]
            ORACLES[name] = (f"SELECT * REPLACE ({', '.join(fixes)}) FROM ({sql}) AS result"
                             if fixes else sql)
        return f
    return wrap
