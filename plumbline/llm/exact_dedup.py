"""Exact duplicates by sorting the contents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.llm.common import hold

#: Characters of a text that enter the splitters of the range partitioning.
SPLITTER_CHARS = 64


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition -> (id, sha, keep, size, part, edge).

    Neighbours are compared in full. Of a run only its ids are held until it ends. The
    first and the last run of a partition may go on in another one and are marked.
    """
    part, ids, shas = 0, [], []
    last_text, last_sha, first = None, None, True

    def flush(edge: bool) -> pa.RecordBatch:
        run = np.concatenate(ids)
        n = len(run)
        return pa.RecordBatch.from_arrays(
            [pa.array(run), pa.array([last_sha] * n, pa.string()), pa.array(np.full(n, run[0])),
             pa.array(np.full(n, n, np.int64)), pa.array(np.full(n, part, np.int64)),
             pa.array(np.full(n, edge))], ["id", "sha", "keep", "size", "part", "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        text, sha = batch.column("t"), batch.column("sha")
        key = batch.column("id").to_numpy(zero_copy_only=False)
        part = batch.column("part")[0].as_py()
        new = np.ones(batch.num_rows, bool)
        new[1:] = pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        new[0] = last_text is None or text[0].as_py() != last_text
        starts = np.flatnonzero(new)
        if ids:
            ids.append(key[:starts[0] if len(starts) else len(key)])
            if len(starts):
                yield flush(first)
                ids, first = [], False
        if len(starts):
            # Runs that begin and end in this batch.
            whole = len(starts) - 1
            if whole:
                lengths = np.diff(starts)
                inner = slice(starts[0], starts[-1])
                n = int(lengths.sum())
                edge = np.zeros(n, bool)
                if first:
                    edge[:lengths[0]] = True
                    first = False
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[inner]), sha[inner.start:inner.stop],
                     pa.array(np.repeat(key[starts[:-1]], lengths)), pa.array(np.repeat(lengths, lengths)),
                     pa.array(np.full(n, part, np.int64)), pa.array(edge)],
                    ["id", "sha", "keep", "size", "part", "edge"])
            ids = [key[starts[-1]:]]
        last_text, last_sha = text[-1].as_py(), sha[-1].as_py()
    if ids:
        yield flush(True)


def group_equal_texts(df: DataFrame, key: str = "doc_id", text: str = "text",
                      normalize: Callable[[Column], Column] | None = None,
                      keep: str = "largest") -> DataFrame:
    """One row per input row: ``key``, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after ``normalize`` (default: no change); null counts
    as empty. Of equal texts the row with the ``largest`` (or ``smallest``) key stays; rows
    that share a key and a text are all marked alike. ``key`` is a whole number; a row
    without one is a group of its own and stays. Extra columns are ignored; an empty table gives an empty table.

    The rows are dealt to ranges by sampled splitters over (text prefix, digest, key).
    The key in the splitters lets a text held by any share of the rows spread over many
    ranges; the splitters stay short whatever the texts are. Each range is sorted with
    spilling to disk, which makes equal texts neighbours. Only runs at the two ends of a
    range can go on elsewhere; these few are joined by their digest.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be largest or smallest, not {keep}")
    sign = -1 if keep == "largest" else 1
    whole = F.coalesce(quoted(text), F.lit(""))
    rows = df.select(quoted(key).cast("long").alias("id"),
                     (normalize(whole) if normalize else whole).alias("t"))
    rows = rows.withColumns({"head": F.substring("t", 1, SPLITTER_CHARS), "sha": F.sha2("t", 256),
                             "rank": sign * F.col("id")})
    order = ["head", "sha", "rank"]
    dealt = rows.filter("id IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order)
    runs = hold(dealt.select("id", "t", "sha", F.spark_partition_id().cast("long").alias("part"))
                .mapInArrow(_runs, "id long, sha string, keep long, size long, part long, edge boolean"))
    best = F.max if keep == "largest" else F.min
    ends = (runs.filter("edge").groupBy("sha", "part").agg(best("keep").alias("keep"), F.max("size").alias("size"))
            .groupBy("sha").agg(best("keep").alias("all_keep"), F.sum("size").alias("all_size")))
    inner = runs.filter("NOT edge").select("id", "sha", "keep", "size")
    outer = runs.filter("edge").join(ends, "sha").select("id", "sha", F.col("all_keep").alias("keep"),
                                                        F.col("all_size").alias("size"))
    # The filter reaches the scan, which skips all row groups without such rows.
    keyless = rows.filter("id IS NULL").select("id", "sha", F.col("id").alias("keep"), F.lit(1).cast("long").alias("size"))
    return inner.unionByName(outer).unionByName(keyless).select(
        F.col("id").alias(key), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"))
