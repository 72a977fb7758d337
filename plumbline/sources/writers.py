"""Writing report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import quoted


def write_report_table(df: DataFrame, path: str, fmt: str = "csv",
                       partition_by: Sequence[str] = ()) -> None:
    """Write a result table; ``partition_by`` gives one folder per value (e.g. feature)."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def json_safe(c: Column, dtype: T.DataType) -> Column:
    """NaN and infinities become null at any nesting depth."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        x = c.cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), c)
    if isinstance(dtype, T.StructType):
        safe = F.struct(*[json_safe(c[f.name], f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(c.isNotNull(), safe)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda e: json_safe(e, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, v: json_safe(v, dtype.valueType))
    return c


def safe_columns(df: DataFrame) -> DataFrame:
    return df.select(*[json_safe(quoted(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def to_json_rows(df: DataFrame, out: str = "json") -> DataFrame:
    """Each row as one JSON text, nulls written out."""
    return safe_columns(df).select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(out))


def write_report_json(df: DataFrame, path: str) -> None:
    safe_columns(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)
