"""Fingerprints of files and of table contents."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted


def file_fingerprint(spark: SparkSession, path: str, expected: str | None = None) -> DataFrame:
    """SHA-256 of each file's bytes. Files over 2 GB do not fit one cell: use
    :func:`content_fingerprint` for those."""
    files = spark.read.format("binaryFile").load(path)
    out = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    return out if expected is None else out.withColumn("matches", F.col("sha256") == expected)


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a row. Null markers are hashed too, since a null alone leaves
    the hash unchanged and would let values move between columns unnoticed."""
    parts = [p for c in df.columns for p in (quoted(c), quoted(c).isNull())]
    return F.xxhash64(*parts)


def content_fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive fingerprint: equal schema and rows give equal hashes.

    Count, wide sum and xor of row hashes are mergeable, so the table is scanned once
    and only one row per task is exchanged.
    """
    schema = hashlib.sha256(",".join(f"{c}:{t}" for c, t in df.dtypes).encode()).hexdigest()
    h = row_hash(df)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("__s"),
                  F.bit_xor(h).alias("__x")).select(
        F.lit(schema).alias("schema_hash"), "rows",
        F.sha2(F.concat_ws(":", F.lit(schema), "rows", F.col("__s").cast("string"),
                           F.col("__x").cast("string")), 256).alias("content_hash"))
