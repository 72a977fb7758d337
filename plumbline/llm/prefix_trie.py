"""The prefix trie of all conversations, from padded matrices of turn ids.

Conversations become rows of 128-bit turn ids and are range-partitioned by (sequence, key), so a
prefix shared by any number of rows is spread over consecutive shards. Inside a shard the padded
matrix is sorted by ``numpy.lexsort``; where a row differs from the one above it in any column so
far, a node starts, and ``reduceat`` sums the rows of every node. Only nodes on the path of the
first or the last row of a shard can go on in another one. Those two rows per shard, with what the
shard knows of their nodes, are sorted once more in the same way and give the whole nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.llm.common import hold

#: Turn ids a shard should hold, columns of the matrix compared at a time, bytes of a piece of a member list.
SHARD_CELLS, TILE, PIECE = 1 << 20, 32, 8192
NO_ENDS = hashlib.sha256(b"").hexdigest()
_TOP = np.iinfo(np.int64).max

_NODE = ("shard int, conv_id long, depth long, parent_conv_id long, side int, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, ends_sha256 string")
_EDGE = ("side int, ids array<long>, n array<long>, conv array<long>, words array<long>, children array<long>, "
         "leaves array<long>, saved array<long>")
_SHARD_ROWS = f"kind string, {_NODE}, edge struct<{_EDGE}>, path binary, part long, piece binary"
_MERGED_ROWS = f"kind string, {_NODE}, path binary, first_convs array<long>, last_convs array<long>"


def turn_sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """(conv, turns): per conversation its turns in order as structs (hi, lo, words).

    Turns are ordered by ``turn``, null first, ties by role and text; equal rows are as many turns.
    Null roles and texts count as empty, rows without a conversation are left out. Texts only move
    for conversations in which different turns share a number. A conversation is one row of 20 bytes
    a turn.
    """
    base = turns.filter(quoted(conv).isNotNull()).select(
        quoted(conv).alias("__conv"), quoted(turn).alias("turn"), F.coalesce(quoted(role), F.lit("")).alias("role"),
        F.coalesce(quoted(text), F.lit("")).alias("text"))
    known = [F.xxhash64("role", "text").alias("hi"), F.xxhash64(F.lit("second"), "text", "role").alias("lo"),
             F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words")]
    grouped = base.select("__conv", "turn", *known).groupBy("__conv").agg(
        F.sort_array(F.collect_list(F.struct("turn", "hi", "lo", "words"))).alias("turns"))
    more = F.size("turns") - 1
    tied = F.exists(F.zip_with(F.slice("turns", 1, more), F.slice("turns", 2, more), lambda a, b: a["turn"].eqNullSafe(
        b["turn"]) & ((a["hi"] != b["hi"]) | (a["lo"] != b["lo"]))), lambda x: x)
    held = hold(grouped.withColumn("tied", tied))
    plain = lambda t: F.struct(t["hi"].alias("hi"), t["lo"].alias("lo"), t["words"].alias("words"))
    if held.filter("tied").first() is None:  # no text has to move
        return held.select(F.col("__conv").alias(conv), F.transform("turns", plain).alias("turns"))
    settled = (base.join(held.filter("tied").select("__conv"), "__conv", "left_semi")
               .select("__conv", "turn", "role", "text", *known).groupBy("__conv")
               .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "hi", "lo", "words"))).alias("turns")))
    both = held.filter("NOT tied").select("__conv", F.transform("turns", plain).alias("turns")).unionByName(
        settled.select("__conv", F.transform("turns", plain).alias("turns")))
    return both.select(F.col("__conv").alias(conv), "turns")


def prefix_trie(sequences: DataFrame, conv: str = "conv_id", turns: str = "turns") -> DataFrame:
    """All nodes of the trie of ``turn_sequences``: one row per distinct sequence of first turns.

    conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves (childless nodes of the subtree), saved_tokens (over the subtree, words of the last turn
    times members but one), ends_sha256 (of the ascending, comma-joined keys of the members that end
    here). Keys are distinct longs; conversations without turns end at the root; no conversation, no
    node.
    """
    spark = sequences.sparkSession
    rows = hold(sequences.filter(quoted(conv).isNotNull()).select(
        quoted(conv).alias("conv_id"), F.flatten(F.transform(turns, lambda t: F.array(t["hi"], t["lo"]))).alias("ids"),
        F.transform(turns, lambda t: t["words"].cast("long")).alias("words")))
    cells = rows.agg(F.coalesce(F.sum(F.size("words") + 1), F.lit(0))).first()[0]
    shards = max(spark.sparkContext.defaultParallelism, -(-cells // SHARD_CELLS))
    found = hold(rows.repartitionByRange(shards, "ids", "conv_id")
                 .withColumn("shard", F.spark_partition_id()).mapInArrow(_shard, _SHARD_ROWS), "kind")
    edges = found.filter("kind = 'edge'").select("shard", "edge.*")
    # Two rows a shard, whatever the table holds.
    merged = hold(edges.repartition(1).sortWithinPartitions("shard", "side").mapInArrow(_merge, _MERGED_ROWS), "kind")
    pieces = found.filter("kind = 'piece'").select("path", "shard", "part", "piece")
    digests = (pieces.repartition("path").sortWithinPartitions("path", "shard", "part")
               .mapInArrow(_digest, "path binary, digest string"))
    columns = [F.col(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                  "saved_tokens", "ends_sha256")]
    shared = (merged.filter("kind = 'node'").drop("ends_sha256").join(digests, "path", "left")
              .withColumn("ends_sha256", F.coalesce("digest", F.lit(NO_ENDS))).select(*columns))
    paths = merged.filter("kind = 'paths'").select("shard", "first_convs", "last_convs")
    above = F.when(F.col("side") == 0, F.get("first_convs", F.col("depth") - 1)).when(
        F.col("side") == 1, F.get("last_convs", F.col("depth") - 1))
    inner = (found.filter("kind = 'node'").join(paths, "shard", "left")
             .withColumn("parent_conv_id", F.coalesce("parent_conv_id", above)).select(*columns))
    return inner.unionByName(shared)


def _flat(batches: list[pa.RecordBatch], name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and row bounds of an array column."""
    parts = [b.column(name) for b in batches]
    values = np.concatenate([p.flatten().to_numpy(zero_copy_only=False) for p in parts])
    sizes = np.concatenate([np.diff(p.offsets.to_numpy()) for p in parts])
    return values, np.concatenate([[0], np.cumsum(sizes)])


def _codes(ids: np.ndarray) -> np.ndarray:
    """Dense numbers from 1 for pairs (hi, lo), in their order."""
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    held = ids[order]
    new = np.ones(len(ids), np.int64)
    new[1:] = (held[1:] != held[:-1]).any(axis=1)
    codes = np.empty(len(ids), np.int64)
    codes[order] = np.cumsum(new)
    return codes


def _tile(codes: np.ndarray, at: np.ndarray, lens: np.ndarray, off: int) -> np.ndarray:
    """Padded matrix of the columns from ``off`` of the rows that start ``at``; padding is 0."""
    width = min(TILE, int(lens.max()) - off)
    place = at[:, None] + off + np.arange(width)
    return np.where(off + np.arange(width) < lens[:, None], codes[np.minimum(place, len(codes) - 1)], 0)


def _changes(matrix: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Where a sorted row differs from the one above it in this column or any before."""
    new = np.ones(matrix.shape, bool)
    new[1:] = matrix[1:] != matrix[:-1]
    new[1:, 0] |= group[1:] != group[:-1]
    return np.logical_or.accumulate(new, axis=1)


def _order(codes: np.ndarray, bounds: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Rows in the order of their sequences, a shorter one before its extensions, then by ``tie``."""
    lens = np.diff(bounds)
    rank = np.zeros(len(lens), np.int64)
    live, off = np.flatnonzero(lens > 0), 0
    while len(live):
        matrix = _tile(codes, bounds[live], lens[live], off)
        order = np.lexsort((*matrix.T[::-1], rank[live]))
        inside = np.cumsum(_changes(matrix[order], rank[live][order])[:, -1])
        # Ranks of all rows so far: those that ended come first within their old rank.
        step = np.zeros(len(lens), np.int64)
        step[live[order]] = inside
        whole = np.lexsort((step, rank))
        new = np.zeros(len(lens), np.int64)
        new[1:] = (np.diff(rank[whole]) != 0) | (np.diff(step[whole]) != 0)
        rank[whole] = np.cumsum(new)
        off += matrix.shape[1]
        live = live[lens[live] > off]
    return np.lexsort((tie, rank))


def _levels(codes: np.ndarray, start: np.ndarray, lens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per depth from 1 (rows that reach it, node of each, place of each node's first row) of sorted rows."""
    live, off = np.flatnonzero(lens > 0), 0
    group = np.zeros(len(lens), np.int64)
    while len(live):
        matrix = _tile(codes, start[live], lens[live], off)
        marks = np.cumsum(_changes(matrix, group[live]), axis=0)
        for j in range(matrix.shape[1]):
            there = lens[live] > off + j
            rows, mark = live[there], marks[there, j]
            new = np.ones(len(rows), bool)
            new[1:] = mark[1:] != mark[:-1]
            yield rows, np.cumsum(new) - 1, np.flatnonzero(new)
        group[live] = marks[:, -1]
        off += matrix.shape[1]
        live = live[lens[live] > off]


def _into(parents: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, parents, values)
    return out


def _table(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    """A batch in which columns not given are null."""
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


_LONGS = pa.list_(pa.int64())
_EDGE_TYPE = pa.struct([("side", pa.int32())] + [(c, _LONGS) for c in (
    "ids", "n", "conv", "words", "children", "leaves", "saved")])
_NODE_FIELDS = [("kind", pa.string()), ("shard", pa.int32()), *[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id")],
                ("side", pa.int32()), *[(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
                ("ends_sha256", pa.string())]
_SHARD_SCHEMA = pa.schema([*_NODE_FIELDS, ("edge", _EDGE_TYPE), ("path", pa.binary()), ("part", pa.int64()), ("piece", pa.binary())])
_MERGED_SCHEMA = pa.schema([*_NODE_FIELDS, ("path", pa.binary()), ("first_convs", _LONGS), ("last_convs", _LONGS)])


def _path(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(np.ascontiguousarray(ids).tobytes(), digest_size=16).digest()


def _members(convs: np.ndarray) -> bytes:
    return ",".join(map(str, convs.tolist())).encode()


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one shard: whole ones, what is known of those on its two outer paths, pieces of their member lists."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    shard = held[0].column("shard")[0].as_py()
    ids, _ = _flat(held, "ids")
    ids = ids.reshape(-1, 2)
    words, bounds = _flat(held, "words")
    convs = np.concatenate([b.column("conv_id").to_numpy(zero_copy_only=False) for b in held])
    codes = _codes(ids)
    order = _order(codes, bounds, convs)
    start, lens, convs = bounds[:-1][order], np.diff(bounds)[order], convs[order]
    last = len(order) - 1
    # Depth 0 is the root, which every shard shares.
    levels = [(np.arange(len(order)), np.zeros(len(order), np.int64), np.zeros(1, np.int64)), *_levels(codes, start, lens)]
    nodes, node_of = [], np.zeros(len(order), np.int64)
    for depth, (rows, node, first) in enumerate(levels):
        parent = node_of[rows[first]] if depth else np.zeros(1, np.int64)
        node_of[rows] = node
        edge = np.full(len(first), -1, np.int32)
        if rows[-1] == last:
            edge[node[-1]] = 1
        if rows[0] == 0:
            edge[0] = 0
        nodes.append({
            "parent": parent, "edge": edge, "n": np.diff(np.append(first, len(rows))),
            "conv": np.minimum.reduceat(convs[rows], first),
            "words": words[start[rows[first]] + depth - 1] if depth else np.zeros(1, np.int64),
            "ends": rows[lens[rows] == depth], "end_node": node[lens[rows] == depth]})
    for depth in range(len(nodes) - 1, -1, -1):
        here, count = nodes[depth], len(nodes[depth]["n"])
        zero = np.zeros(count, np.int64)
        here["children"], here["leaves"], here["saved"] = zero, zero.copy(), zero.copy()
        if depth + 1 < len(nodes):
            below = nodes[depth + 1]
            whole = below["edge"] < 0
            up = below["parent"][whole]
            here["children"] = _into(up, np.ones(len(up), np.int64), count)
            here["leaves"] = _into(up, below["leaves"][whole], count)
            here["saved"] = _into(up, below["saved"][whole], count)
        whole = here["edge"] < 0
        here["leaves"] += whole & (here["children"] == 0)
        here["saved"] += np.where(whole, (here["n"] - 1) * here["words"], 0)

    path_ids = [ids[start[i]:start[i] + lens[i]] for i in (0, last)]
    for depth, here in enumerate(nodes):
        digests = np.full(len(here["n"]), NO_ENDS, object)
        firsts = np.flatnonzero(np.diff(here["end_node"], prepend=-1))
        for a, b in zip(firsts, np.append(firsts[1:], len(here["end_node"]))):
            node, members = here["end_node"][a], convs[here["ends"][a:b]]
            if here["edge"][node] < 0:
                digests[node] = hashlib.sha256(_members(members)).hexdigest()
                continue
            key = _path(path_ids[here["edge"][node]][:depth])
            for part, i in enumerate(range(0, len(members), PIECE // 8)):
                yield _table(_SHARD_SCHEMA, 1, kind=["piece"], shard=[shard], path=[key], part=[part],
                             piece=[_members(members[i:i + PIECE // 8])])
        whole = np.flatnonzero(here["edge"] < 0)
        if depth and len(whole):
            above, up = nodes[depth - 1], here["parent"][whole]
            side = above["edge"][up]
            yield _table(_SHARD_SCHEMA, len(whole), kind=["node"] * len(whole), shard=np.full(len(whole), shard), conv_id=here["conv"][whole],
                         depth=np.full(len(whole), depth), side=side,
                         parent_conv_id=pa.array(above["conv"][up], mask=side >= 0), n_convs=here["n"][whole],
                         n_children=here["children"][whole], n_leaves=here["leaves"][whole],
                         saved_tokens=here["saved"][whole], ends_sha256=digests[whole].tolist())
    for side, row in ((0, 0), (1, last)):
        size = lens[row] + 1
        edge = {c: np.full(size, _TOP) if c == "conv" else np.zeros(size, np.int64)
                for c in ("n", "conv", "words", "children", "leaves", "saved")}
        for depth in range(size):
            at = np.flatnonzero(nodes[depth]["edge"] == side)  # nodes of both paths belong to the first one
            for c, values in edge.items():
                if len(at):
                    values[depth] = nodes[depth][c][at[0]]
        body = {"side": side, "ids": path_ids[side].ravel().tolist(), **{c: v.tolist() for c, v in edge.items()}}
        yield _table(_SHARD_SCHEMA, 1, kind=["edge"], shard=[shard], edge=[body])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole nodes from the outer paths of all shards, and per shard the smallest members along its paths."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    ids, _ = _flat(held, "ids")
    ids = ids.reshape(-1, 2)
    parts = {}
    for c in ("n", "conv", "words", "children", "leaves", "saved"):
        parts[c], at = _flat(held, c)
    at = at[:-1]  # of each path's value at depth 0
    lens = np.diff(np.append(at, len(parts["n"]))) - 1
    bounds = np.concatenate([[0], np.cumsum(lens)])
    codes = _codes(ids)
    order = _order(codes, bounds, np.arange(len(lens)))
    start, lens, at = bounds[:-1][order], lens[order], at[order]
    levels = [(np.arange(len(order)), np.zeros(len(order), np.int64), np.zeros(1, np.int64)), *_levels(codes, start, lens)]
    nodes, node_of, along = [], np.zeros(len(order), np.int64), [[] for _ in order]
    for depth, (rows, node, first) in enumerate(levels):
        parent = node_of[rows[first]] if depth else np.zeros(1, np.int64)
        node_of[rows] = node
        cells = at[rows] + depth
        here = {c: np.add.reduceat(parts[c][cells], first) for c in ("n", "children", "leaves", "saved")}
        here |= {"parent": parent, "conv": np.minimum.reduceat(parts["conv"][cells], first),
                 "words": np.maximum.reduceat(parts["words"][cells], first), "row": rows[first]}
        for row, conv in zip(rows.tolist(), here["conv"][node].tolist()):
            along[row].append(conv)
        nodes.append(here)
    for depth in range(len(nodes) - 1, -1, -1):
        here, count = nodes[depth], len(nodes[depth]["n"])
        if depth + 1 < len(nodes):
            below = nodes[depth + 1]
            here["children"] += _into(below["parent"], np.ones(len(below["parent"]), np.int64), count)
            here["leaves"] += _into(below["parent"], below["leaves"], count)
            here["saved"] += _into(below["parent"], below["saved"], count)
        here["leaves"] += here["children"] == 0
        here["saved"] += (here["n"] - 1) * here["words"]
        yield _table(_MERGED_SCHEMA, count, kind=["node"] * count, conv_id=here["conv"], depth=np.full(count, depth), n_convs=here["n"],
                     parent_conv_id=nodes[depth - 1]["conv"][here["parent"]] if depth else [None],
                     n_children=here["children"], n_leaves=here["leaves"], saved_tokens=here["saved"],
                     path=[_path(ids[start[r]:start[r] + depth]) for r in here["row"]])
    shards = np.concatenate([b.column("shard").to_numpy(zero_copy_only=False) for b in held])[order]
    sides = np.concatenate([b.column("side").to_numpy(zero_copy_only=False) for b in held])[order]
    paths: dict[int, list] = {}
    for shard, side, convs in zip(shards.tolist(), sides.tolist(), along):
        paths.setdefault(shard, [None, None])[side] = convs
    yield _table(_MERGED_SCHEMA, len(paths), kind=["paths"] * len(paths), shard=list(paths), first_convs=[p[0] for p in paths.values()],
                 last_convs=[p[1] for p in paths.values()])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, SHA-256 of its pieces joined by commas) from pieces in order."""
    path, digest = None, None
    for batch in batches:
        done = []
        for p, piece in zip(batch.column("path").to_pylist(), batch.column("piece").to_pylist()):
            if p == path:
                digest.update(b",")
            else:
                if path is not None:
                    done.append((path, digest.hexdigest()))
                path, digest = p, hashlib.sha256()
            digest.update(piece)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])],
                                             ["path", "digest"])
    if path is not None:
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([digest.hexdigest()])], ["path", "digest"])


def with_borrowed_starts(sequences: DataFrame, conv: str, turns: str, block: int, most: int) -> DataFrame:
    """Sequences whose first h turns come from the first conversation of their block of ``block`` keys.

    h is the unsigned crc32 of the key as text, modulo ``most`` + 1. All turns of a shorter first
    conversation are taken, none of an absent one; then the own turns after the first h follow.
    """
    c, own = quoted(conv), quoted(turns)
    h = (F.crc32(c.cast("string").cast("binary")) % (most + 1)).cast("int")
    heads = sequences.filter(c % block == 0).select(c.alias("__head"), F.slice(own, 1, most).alias("__taken"))
    joined = sequences.withColumn("__head", c - c % block).join(heads, "__head", "left")
    none: Column = F.array().cast(sequences.schema[turns].dataType)
    return joined.select(c.alias(conv), F.concat(
        F.slice(F.coalesce("__taken", none), F.lit(1), h), F.slice(own, h + 1, F.size(own))).alias(turns))
