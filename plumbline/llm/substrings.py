"""Removal of repeated passages with compressed full-text indexes, one per shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.llm.common import CACHE_ENTRIES, BitFilter, hold, ngram_ids, release, text_batches
from plumbline.session import forget

#: Words of an anchor. A window is sent to a shard by the smallest anchor hash inside it.
ANCHOR = 6
#: Words of a shard's index, unless a single anchor has more.
SHARD_WORDS = 1 << 18
#: An anchor with more distinct segments than this is split by the windows themselves.
HOT_SEGMENTS = 5_000
#: Bytes of a word's code inside the index.
CODE = 6


class _Words(dict):
    """word -> id: 58 bits of its hash below 6 bits for its length."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word) >> 6 | min(len(word), 63) << 58
        return value

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _extreme(values: np.ndarray, width: int, choose) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = choose(values[:-step], values[step:])
        done += step
    return values


def window_anchors(ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest anchor hash of every window, anchor of every position where one was taken)."""
    if len(ids) < window:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    # Long words are rare ones. With the bytes of the words in front of the hash, the smallest
    # value is a sequence that seldom comes back by chance.
    m = min(ANCHOR, window)
    size = np.convolve((ids >> np.uint64(58)).astype(np.int64), np.ones(m, np.int64), "valid")
    grams = (np.uint64(1023) - np.minimum(size, 1023).astype(np.uint64)) << np.uint64(54)
    grams |= ngram_ids(ids, m) >> np.uint64(10)
    width = len(grams) - (len(ids) - window)
    least = _extreme(grams, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    most = _extreme(np.concatenate([pad, least, pad]), width, np.maximum)
    return least, grams[most == grams]


class WaveletMatrix:
    """Rank over a sequence of symbols; one bit vector per bit of a symbol, packed in words."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels, self.words, self.ranks, self.zeros = levels, [], [], []
        n = len(symbols)
        for level in range(levels - 1, -1, -1):
            bits = ((symbols >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.append(bits, np.zeros(-n % 64 + 64, np.uint8)), bitorder="little").view(np.uint64)
            counts = np.bitwise_count(packed).astype(np.int64)
            self.words.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(counts)[:-1]]))
            self.zeros.append(n - int(bits.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` of the sequence lies in the run of ``symbol`` at the lowest level."""
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            block = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ranks[i][block] + np.bitwise_count(self.words[i][block] & below)
            at = np.where((symbol >> level) & 1, self.zeros[i] + ones, at - ones)
        return at


class ShardIndex:
    """FM-index over segments of words: suffix order, its last column in a wavelet matrix.

    Suffixes are ordered by their first 32 words or more; that is enough for backward search
    of patterns up to that length. Segments are separated by a symbol no word has.
    """

    def __init__(self, segments: list[np.ndarray], window: int) -> None:
        self.window = window
        lengths = np.array([len(s) for s in segments])
        self.first = np.cumsum(lengths + 1) - lengths - 1
        joined = np.zeros(int((lengths + 1).sum()), np.int64)
        inside = np.ones(len(joined), bool)
        inside[self.first + lengths] = False
        _, codes = np.unique(np.concatenate(segments), return_inverse=True)
        joined[inside] = codes + 1
        self.text, n = joined, len(joined)
        self.seed, rank, done = 1, joined, 1
        self.seeds = rank
        while done < window:
            follow = np.zeros(n, np.int64)
            follow[:-done] = rank[done:]
            _, rank = np.unique(rank * (int(rank.max()) + 1) + follow, return_inverse=True)
            rank, done = rank + 1, done * 2
            if done <= window:
                self.seed, self.seeds = done, rank
        self.order = np.argsort(rank, kind="stable")
        column = joined[self.order - 1]
        self.tree = WaveletMatrix(column, max(1, int(joined.max()).bit_length()))
        starts = np.concatenate([[0], np.cumsum(np.bincount(joined))])[:-1]
        every = np.arange(len(starts))
        self.base = starts - self.tree.descend(every, np.zeros(len(starts), np.int64))

    def occurrences(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of the windows that start at positions ``at`` of the text.

        The ranges of the last words of a window come from a table left over from sorting;
        backward search adds the words before them, dropping windows that occur only once.
        """
        sorted_seeds = self.seeds[self.order]
        tail = self.seeds[at + self.window - self.seed]
        low = np.searchsorted(sorted_seeds, tail, "left")
        high = np.searchsorted(sorted_seeds, tail, "right")
        live = np.flatnonzero(high - low > 1)
        for j in range(self.window - self.seed - 1, -1, -1):
            c = self.text[at[live] + j]
            low[live] = self.base[c] + self.tree.descend(c, low[live])
            high[live] = self.base[c] + self.tree.descend(c, high[live])
            live = live[high[live] - low[live] > 1]
        return low, high

    def earliest(self, docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, doc, place) of every window: where its words start first.

        ``docs`` and ``places`` say where each segment itself starts first.
        """
        count = np.diff(np.append(self.first, len(self.text))) - self.window
        owner = np.repeat(np.arange(len(count)), count)
        shift = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        at = self.first[owner] + shift
        doc, place = docs[owner], places[owner] + shift
        low, high = self.occurrences(at)
        many = np.flatnonzero(high - low > 1)
        if len(many):
            by_age = np.lexsort((place, doc))
            age = np.full(len(self.text) + 1, len(owner), np.int64)
            age[at[by_age]] = np.arange(len(by_age))
            lows, back = np.unique(low[many], return_inverse=True)
            ends = np.zeros(len(lows), np.int64)
            ends[back] = high[many]
            in_order = np.append(age[self.order], len(owner))
            oldest = np.minimum.reduceat(in_order, np.stack([lows, ends], 1).ravel())[::2]
            first = by_age[oldest[back]]
            doc, place = doc.copy(), place.copy()
            doc[many], place[many] = docs[owner[first]], places[owner[first]] + shift[first]
        return owner, doc, place


def _documents(window: int):
    """Rows (0, id, n, sha) per text and (1, digest, anchor) per anchor.

    The digest stands for the words of the text, so that equal texts count as one place. An
    anchor met at several places of a text comes with a second digest.
    """
    names = ["kind", "id", "n", "sha"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for rows in text_batches(batches):
            n, sha, owners, anchors = [], [], [], []
            for k, t in rows:
                words = _split(t)
                _, taken = window_anchors(known.ids(words), window)
                values, counts = np.unique(taken, return_counts=True)
                n.append(len(words))
                digest = hashlib.sha256(b" ".join(words))
                sha.append(digest.hexdigest())
                own = int.from_bytes(digest.digest()[:8], "little", signed=True)
                twice = values[counts > 1]
                anchors += [values, twice]
                owners += [np.full(len(values), own), np.full(len(twice), own ^ 1)]
            keys = pa.array([k for k, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int8)), keys, pa.array(n, pa.int64()),
                                              pa.array(sha, pa.string())], names)
            found = np.concatenate(anchors).view(np.int64)
            if len(found):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(len(found), np.int8)), pa.array(np.concatenate(owners)),
                     pa.array(found), pa.nulls(len(found), pa.string())], names)
    return run


def _segments(window: int, again):
    """Rows (id, anchor, content, start, windows, words) of every run of windows with a repeated anchor.

    A task sends the words of equal segments once, as long as it remembers them.
    """
    names = ["id", "anchor", "content", "start", "count", "body"]
    kinds = [*[pa.int64()] * 5, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sent = _Words(), set()
        for rows in text_batches(batches):
            out = []
            for k, text in rows:
                ids = known.ids(_split(text))
                least, _ = window_anchors(ids, window)
                new = np.ones(len(least), bool)
                new[1:] = least[1:] != least[:-1]
                starts = np.flatnonzero(new)
                ends = np.append(starts[1:], len(least))
                here = np.flatnonzero(again.value.holds(least[starts]))
                codes = ids.view(np.uint8).reshape(-1, 8)[:, :CODE]
                if len(sent) > CACHE_ENTRIES:
                    sent.clear()
                for a, b in zip(starts[here].tolist(), ends[here].tolist()):
                    content = xxhash.xxh3_64_intdigest(ids[a:b + window - 1].tobytes()) - (1 << 63)
                    body = None if content in sent else codes[a:b + window - 1].tobytes()
                    sent.add(content)
                    out.append((k, int(least[a].view(np.int64)), content, a, b - a, body))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
    return run


def _search(window: int):
    """Distinct segments sorted by route -> runs of windows with where they start first."""
    names = ["content", "route", "offset", "count", "doc", "place"]

    def one(rows: list[tuple]) -> pa.RecordBatch:
        words = [np.frombuffer(r[4], np.uint8).reshape(-1, CODE) for r in rows]
        wide = np.zeros((sum(map(len, words)), 8), np.uint8)
        wide[:, :CODE] = np.concatenate(words)
        ids = np.split(wide.view(np.uint64).ravel(), np.cumsum([len(w) for w in words])[:-1])
        owner, doc, place = ShardIndex(ids, window).earliest(
            np.array([r[2] for r in rows]), np.array([r[3] for r in rows]))
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)
        at = np.flatnonzero(new)
        first = np.searchsorted(owner, owner[at])
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][1] for i in owner[at]], pa.int64()), pa.array([rows[i][0] for i in owner[at]], pa.int64()),
             pa.array(at - first), pa.array(np.diff(np.append(at, len(owner)))), pa.array(doc[at]), pa.array(place[at])],
            names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and total >= SHARD_WORDS and row[0] != last:
                    yield one(held)
                    held, total = [], 0
                held.append(row)
                total += len(row[4]) // CODE + 1
                last = row[0]
        if held:
            yield one(held)
    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, word intervals) -> (id, kept digest, removed words, merged spans)."""
    for batch in batches:
        out = []
        for k, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            words = _split(text)
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, [s["a"] for s in spans], 1)
            np.add.at(change, [s["b"] for s in spans], -1)
            gone = np.cumsum(change[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
            out.append((k, hashlib.sha256(kept).hexdigest(), int(gone.sum()),
                        [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]))
        ids, sha, n, spans = zip(*out) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sha, pa.string()), pa.array(n, pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["id", "sha", "removed", "spans"])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """``key``, n_words, n_removed, kept_sha256, removed_spans: one row per input row.

    A word goes when a window of ``window`` consecutive words over it starts earlier in the
    corpus too: in a row with a smaller key, or before in the same one. Windows are judged on
    the input. removed_spans are the removed [start, end) word positions, the digest is
    SHA-256 of the kept words joined by one space. Null, empty and short texts lose
    nothing. Keys are whole numbers without nulls; rows that share a key must share the text.
    Extra columns are ignored, an empty table gives no rows.

    1. Texts of equal words are one: all but the smallest key lose every word.
    2. The smallest hash of the short word sequences inside a window is its anchor. Equal
       windows have equal anchors, so only windows whose anchor occurs at two places matter. A bit
       filter of fixed size holds those anchors; what it lets through besides is found single later.
    3. Runs of windows with one anchor are segments. Equal segments are one, with the place where
       they start first, so a passage copied any number of times is indexed once.
       Segments are dealt to shards by anchor; an anchor with very many different segments is
       dealt by its single windows instead.
    4. A shard builds a compressed full-text index of its segments and streams their windows
       through backward search. The range of a window's occurrences gives its earliest start.
    5. Runs of windows that start earlier elsewhere become intervals of their documents.
    """
    spark = df.sparkSession
    docs = df.select(quoted(key).cast("long").alias("id"), quoted(text).alias("t"))
    seen = hold(docs.mapInArrow(_documents(window), "kind byte, id long, n long, sha string"))
    texts = seen.filter("kind = 0").select("id", "n", "sha")
    groups = texts.groupBy("sha", "n").agg(F.min("id").alias("rep"))
    rows = hold(texts.join(groups, ["sha", "n"]).select("id", "n", "sha", "rep"))
    copies = hold(rows.filter("id <> rep").select("id").distinct())
    again = (seen.filter("kind = 1").groupBy(F.col("n").alias("anchor")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
             .filter("lo < hi").select("anchor"))
    filtered = spark.sparkContext.broadcast(BitFilter.of(again))
    # The anchors and what has been shuffled so far are not needed any more.
    release(seen)
    del seen, texts, groups, again
    forget(spark)
    segments = hold(docs.mapInArrow(
        _segments(window, filtered), "id long, anchor long, content long, start long, count long, body binary"))
    filtered.unpersist()
    found = segments.groupBy("anchor", "content").agg(
        F.min(F.struct("id", "start")).alias("first"), F.max("count").alias("count"), F.max("body").alias("body"))
    distinct = hold(found.select(F.col("anchor").alias("route"), "content", "first.id", "first.start", "count", "body"))
    placed = hold(segments.select(F.col("anchor").alias("route"), "content", "id", "start").join(copies, "id", "left_anti"))
    release(segments)
    del found, segments
    forget(spark)
    hot = hold(distinct.groupBy("route").agg(F.count(F.lit(1)).alias("n"))
               .filter(F.col("n") > HOT_SEGMENTS).select("route"))
    # Single windows of hot anchors: their own hash is both route and content.
    piece = F.substr("body", (F.col("i") * CODE + 1).cast("int"), F.lit(window * CODE))
    windows = (distinct.join(hot, "route", "left_semi")
               .select("*", F.explode(F.expr("sequence(0L, count - 1)")).alias("i")).withColumn("body", piece)
               .select(F.xxhash64("body").alias("own_route"), F.xxhash64("body", F.lit(1)).alias("own_content"),
                       "route", "content", "i", "id", (F.col("start") + F.col("i")).alias("start"), "body"))
    single = (windows.groupBy("own_route", "own_content")
              .agg(F.min(F.struct("id", "start")).alias("first"), F.max("body").alias("body"))
              .select(F.col("own_route").alias("route"), F.col("own_content").alias("content"),
                      "first.id", "first.start", "body"))
    indexed = distinct.join(hot, "route", "left_anti").select("route", "content", "id", "start", "body").union(single)
    runs = hold(indexed.repartition("route").sortWithinPartitions("route").mapInArrow(
        _search(window), "content long, route long, offset long, count long, doc long, place long"))
    split = (windows.select("own_route", "own_content", "route", "content", "i")
             .join(runs.drop("offset").withColumnsRenamed({"route": "own_route", "content": "own_content"}),
                   ["own_route", "own_content"])
             .select("content", "route", F.col("i").alias("offset"), "count", "doc", "place"))
    del indexed, single
    forget(spark)
    late = (placed.join(runs.union(split), ["route", "content"])
            .filter("NOT (doc = id AND place = start + offset)")
            .select("id", (F.col("start") + F.col("offset")).alias("a"),
                    (F.col("start") + F.col("offset") + F.col("count") + F.lit(window - 1)).alias("b")))
    spans = late.groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    changed = hold(docs.join(spans, "id").select("id", "t", "spans").mapInArrow(
        _apply, "id long, sha string, removed long, spans array<struct<start:long,end:long>>")).dropDuplicates(["id"])
    copy = (F.col("id") != F.col("rep")) & (F.col("n") >= window)
    done = rows.join(changed.withColumnRenamed("sha", "new_sha"), "id", "left")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    return done.select(
        F.col("id").alias(key), F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256"),
        F.when(copy, everything).otherwise(F.coalesce("spans", F.slice(everything, 1, 0))).alias("removed_spans"))
