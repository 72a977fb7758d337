"""Scoring a stream with a fitted model: stateless, so no watermark is needed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from plumbline.operators.models import score


def score_stream(spark: SparkSession, model, source: str, schema: StructType, features: Sequence[str],
                 threshold: float = 0.5, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """Files arriving under ``source`` as a scored streaming DataFrame."""
    rows = (spark.readStream.format(fmt).schema(schema)
            .option("maxFilesPerTrigger", files_per_trigger).load(source))
    return score(rows, model, threshold, features)


def write_stream(scored: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append scored rows as Parquet; offsets in ``checkpoint`` make restarts exactly once."""
    writer = scored.writeStream.format("parquet").option("path", target).option(
        "checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
