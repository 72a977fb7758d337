"""Reading tables and prior reports."""

from __future__ import annotations

import json
import sys
from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import as_column

# Ship the JSON walk with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Score of a path by the words in it; lower is preferred, 100 is neutral.
PATH_SCORES = {"raw": -30, "data": -20, "dataset": -20, "employee": -15,
               "train": 10, "test": 20, "processed": 5}
# Folders never searched for tables.
IGNORED_FOLDERS = (".git", ".venv", "venv", "__pycache__", "reports", ".pytest_cache", ".mypy_cache")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with header; a missing file or an empty table is an error.

    With a schema the file is read once; without one the types are inferred.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return _not_empty(reader.csv(path), path)


def _not_empty(df: DataFrame, path: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{path} holds no rows")
    return df


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Choose the reader by extension: csv, parquet, json or orc."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext == "csv":
        return read_table(spark, path, schema)
    if ext in ("parquet", "json", "orc"):
        reader = spark.read.format(ext)
        return _not_empty((reader.schema(schema) if schema is not None else reader).load(path), path)
    raise ValueError(f"no reader for .{ext}")


def discover_datasets(spark: SparkSession, root: str,
                      exts: Sequence[str] = ("csv", "parquet")) -> DataFrame:
    """Data files under a folder with their priority; rank 1 is the likeliest source table.

    Only paths and lengths are read, never file contents.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .load(root).select("path", "length"))
    low = F.lower("path")
    wanted = low.rlike(r"\.(" + "|".join(exts) + ")$")
    for folder in IGNORED_FOLDERS:
        wanted = wanted & ~low.contains(f"/{folder}/")
    score = F.lit(100)
    for word, points in PATH_SCORES.items():
        score = score + F.when(low.contains(word), points).otherwise(0)
    from pyspark.sql import Window
    ranked = files.filter(wanted).select(
        "path", "length", score.alias("score"), F.size(F.split("path", "/")).alias("depth"))
    order = Window.orderBy("score", "depth", "path")  # one row per file found
    return ranked.withColumn("rank", F.row_number().over(order))


def load_evidence(spark: SparkSession, paths: dict[str, str],
                  required: Sequence[str] = ()) -> tuple[dict[str, DataFrame], DataFrame]:
    """Prior CSV/JSON reports by name, and a table of what could be read.

    Missing and corrupt files are tolerated and reported as unavailable.
    """
    tables: dict[str, DataFrame] = {}
    status = []
    for name, path in paths.items():
        rows = 0
        try:
            if path.endswith(".json"):
                df = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(path)
                if df.columns == ["_corrupt_record"]:
                    df = None
            else:
                df = spark.read.option("header", True).option("inferSchema", True).csv(path)
            if df is not None and df.columns:
                rows = df.count()
                tables[name] = df
        except AnalysisException:
            pass
        status.append((name, path, name in required, name in tables, rows))
    availability = spark.createDataFrame(
        status, "name string, path string, required boolean, available boolean, rows long")
    return tables, availability


def _first_scalar(doc: str | None, keys: frozenset[str]) -> str | None:
    if doc is None:
        return None
    try:
        stack = [json.loads(doc)]
    except ValueError:
        return None
    # Depth first: a matching scalar is met before anything nested deeper behind it.
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            key, node = node
            if key.strip().lower() in keys and isinstance(node, (str, int, float, bool)):
                return node if isinstance(node, str) else json.dumps(node)
        if isinstance(node, dict):
            stack.extend(reversed(list(node.items())))
        elif isinstance(node, list):
            stack.extend(reversed(node))
    return None


def json_find(doc: str | Column, keys: Sequence[str]) -> Column:
    """First scalar found depth first under any of several keys of a JSON text, as text.

    Nesting depth is unlimited, which built-in path functions cannot express.
    """
    wanted = frozenset(k.strip().lower() for k in keys)

    @F.pandas_udf("string")
    def find(s: pd.Series) -> pd.Series:
        return s.map(lambda d: _first_scalar(d, wanted))

    return find(as_column(doc))
