"""Exact nearest binary codes by incremental multi-index hashing."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.llm.common import hold

#: A code has SEGMENTS segments of SEGMENT_BITS bits, each with its own table.
SEGMENTS, SEGMENT_BITS = 4, 16
BITS = SEGMENTS * SEGMENT_BITS
#: Codes of an index block and query codes of a query block, at most on average.
INDEX_BLOCK, QUERY_BLOCK = 65_536, 4_096
#: Query codes searched together inside a task.
CHUNK = 64


def sign_code(vector: Column, whole: bool = False) -> Column:
    """64-bit code of a vector: bit i is set where component i is above 0.

    Components beyond 64 are ignored or, with ``whole``, an error, so that nobody ranks wider
    vectors by a prefix unawares. Missing, null and NaN ones count as not above 0. A null
    vector has no code.
    """
    if whole:
        vector = F.when(F.size(vector) > BITS, F.raise_error(F.lit(f"a vector has more than {BITS} components"))).otherwise(vector)
    def bit(x: Column, i: Column) -> Column:
        on = (x > 0) & ~F.isnan(x)
        return F.when(F.coalesce(on, F.lit(False)), F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))) \
            .otherwise(F.lit(0).cast("long"))
    return F.when(vector.isNotNull(), F.aggregate(
        F.transform(F.slice(vector, 1, BITS), bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def _masks(weight: int) -> np.ndarray:
    """All segment values with ``weight`` bits set."""
    return np.array([sum(1 << i for i in c) for c in itertools.combinations(range(SEGMENT_BITS), weight)], np.int64)


class MultiIndex:
    """One sorted table per segment over the distinct codes of a block."""

    def __init__(self, codes: np.ndarray, copies: np.ndarray) -> None:
        self.codes, self.copies = codes.astype(np.uint64), copies
        self.tables = []
        for s in range(SEGMENTS):
            part = self.segment(self.codes, s)
            self.tables.append((np.argsort(part, kind="stable"),
                                np.concatenate([[0], np.cumsum(np.bincount(part, minlength=1 << SEGMENT_BITS))])))

    @staticmethod
    def segment(codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes >> np.uint64(s * SEGMENT_BITS)) & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.int64)

    def search(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query (code positions, distances) that hold every copy among its k nearest.

        Step (r, s) looks up all values at distance r in segment s. After it, a code that
        was not met differs by more than r in the segments up to s and by r or more in the
        others, so every code within SEGMENTS * r + s is known. A query ends as soon as the
        known copies within that distance number k, or everything is covered.
        """
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)
        open_ = np.arange(len(queries))
        keys = np.empty(0, np.int64)  # query * number of codes + code, sorted, verified
        n = len(self.codes)
        for r in range(SEGMENT_BITS + 1):
            masks = _masks(r)
            for s in range(SEGMENTS):
                order, ends = self.tables[s]
                probe = (self.segment(queries[open_], s)[:, None] ^ masks[None, :]).ravel()
                count = ends[probe + 1] - ends[probe]
                total = int(count.sum())
                at = np.repeat(ends[probe] - (np.cumsum(count) - count), count) + np.arange(total)
                who = np.repeat(np.repeat(open_, len(masks)), count)
                keys = np.union1d(keys, who * n + order[at])
                covered = SEGMENTS * r + s
                if covered < 3:
                    continue
                q, c = keys // n, keys % n
                dist = np.bitwise_count(queries[q] ^ self.codes[c]).astype(np.int64)
                sure = np.bincount(q[dist <= covered], self.copies[c[dist <= covered]], len(queries))
                done = open_[(sure[open_] >= k) | (r == SEGMENT_BITS and s == SEGMENTS - 1)]
                if len(done):
                    for i in done.tolist():
                        mine = (q == i) & (dist <= covered)
                        found[i] = (c[mine], dist[mine])
                    open_ = np.setdiff1d(open_, done)
                    keys = keys[np.isin(q, open_)]
                if not len(open_):
                    return found
        return found


def nearest(df: DataFrame, code: str, key: str, is_query: Column, k: int) -> DataFrame:
    """(query_id, neighbor_id, rank, distance): the exact k nearest other rows of every query.

    Ties in Hamming distance are broken by the smaller key. Rows with a null code neither
    ask nor answer. With fewer than k other rows all of them are returned. Repeated keys
    count once per distinct code; a row is never its own neighbour. Extra columns are
    ignored; an empty table gives no rows.

    Equal codes are one entry of the index, which keeps their k + 1 smallest keys: no more of
    them can be among k neighbours, so a code held by a third of all rows costs no more
    than another. Index and query codes are dealt to blocks of bounded size by hash; every pair
    of blocks is one task, and the best of all blocks are ranked per query.
    """
    rows = df.filter(quoted(code).isNotNull() & quoted(key).isNotNull()).select(
        quoted(key).alias("id"), quoted(code).alias("code"), is_query.alias("asks"))
    first = Window.partitionBy("code").orderBy("id")
    entries = hold(rows.select("code", "id").withColumn("__n", F.row_number().over(first))
                   .filter(F.col("__n") <= k + 1).groupBy("code").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    asked = hold(rows.filter("asks").select("id", "code").distinct())
    asked_codes = asked.select("code").distinct()
    n_index = max(1, -(-entries.count() // INDEX_BLOCK))
    n_query = max(1, -(-asked_codes.count() // QUERY_BLOCK))
    mixed = F.xxhash64("code")
    left = asked_codes.select("code", F.pmod(mixed, F.lit(n_query)).alias("qb"),
                              F.explode(F.expr(f"sequence(0L, {n_index - 1}L)")).alias("ib"))
    right = entries.select("code", F.size("ids").alias("copies"), F.pmod(mixed, F.lit(n_index)).alias("ib"),
                           F.explode(F.expr(f"sequence(0L, {n_query - 1}L)")).alias("qb"))

    def search(q: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(index):
            table = MultiIndex(index["code"].to_numpy().view(np.uint64), index["copies"].to_numpy())
            asks = q["code"].to_numpy()
            for at in range(0, len(asks), CHUNK):
                part = asks[at:at + CHUNK]
                for a, (c, d) in zip(part, table.search(part.view(np.uint64), k + 1)):
                    # Beyond the distance at which k + 1 copies are reached nothing can matter.
                    by = np.argsort(d, kind="stable")
                    reach = np.searchsorted(np.cumsum(table.copies[c[by]]), k + 1)
                    keep = d <= d[by][min(reach, len(by) - 1)] if len(by) else d < 0
                    out.append(pd.DataFrame({"asked": a, "code": table.codes[c[keep]].view(np.int64), "distance": d[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"asked": [], "code": [], "distance": []}).astype("int64")

    hits = left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib")).applyInPandas(
        search, "asked long, code long, distance long")
    # Per asked code the k + 1 smallest (distance, id), by ids taken from the entries.
    near = (hits.join(entries, "code").select("asked", "distance", F.explode("ids").alias("neighbor_id")))
    best = Window.partitionBy("asked").orderBy("distance", "neighbor_id")
    top = near.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    pairs = (asked.join(top, asked["code"] == top["asked"]).filter(F.col("id") != F.col("neighbor_id"))
             .select(F.col("id").alias("query_id"), "neighbor_id", "distance"))
    rank = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return (pairs.groupBy("query_id", "neighbor_id").agg(F.min("distance").alias("distance"))
            .withColumn("rank", F.row_number().over(rank).cast("long")).filter(F.col("rank") <= k)
            .select("query_id", "neighbor_id", "rank", "distance"))
