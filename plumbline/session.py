"""Session settings and lineage cuts."""

from __future__ import annotations

import gc
import tempfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table that is broadcast; beyond it joins shuffle both sides.
BROADCAST_ROWS = 500_000
#: Bytes of rows in a batch for a Python worker.
BATCH_BYTES = 4 << 20


def work_folder(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Only a session in local mode may leave it unset; it then gets one temporary folder. On a
    cluster there is no folder to guess that all machines share, so an error is raised.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all machines share")
    return _local_folder(spark.sparkContext.applicationId)


@lru_cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="plumbline-")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the work folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(work_folder(spark))
    return df.checkpoint(eager=True)


def forget(spark: SparkSession) -> None:
    """Have the shuffle files of frames that are gone removed: the driver does so when it collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to the session's Python workers in batches of a few MB, however long they are.

    A batch is held by the executor and by the worker, several times while it grows. A lower bound of the session stays.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting)))
    if not 0 < bound <= BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A join side that is usually tiny but whose size depends on the data.

    It is computed once and counted; only up to ``limit`` rows it is marked for
    broadcast, otherwise the join shuffles as usual. Without this the planner cannot
    know the size and would shuffle the large side too.
    """
    kept = materialize(df)
    return F.broadcast(kept) if kept.limit(limit + 1).count() <= limit else kept
