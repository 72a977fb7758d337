"""Near duplicates by n-gram Jaccard similarity, filtered under several global token orders."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.llm.common import BitFilter, giving_back, hold, mix64, ngram_ids, release
from plumbline.session import forget

#: Words of 64 bits of the parity bitmap of a set.
BITMAP = 8
#: Seeds of the token orders; the first one draws the candidates, the others filter them.
ORDERS = (11, 23, 37)
#: A token among the first ones of more texts than this goes behind all others. So many times the
#: prefix are the first tokens whose frequency is looked at.
COMMON, LOOK = 6, 2
#: More hubs of a token whose sets lie in more than so many components.
HUBS = 8
#: Tokens before one in a set that tell whether a pair has been met already.
BEFORE = 4
#: Bytes of the texts that are worked on together (a text counts for at least ``LEAST``), and of words that are hashed together.
TOGETHER, LEAST, PIECE = 1 << 20, 512, 1 << 18
#: The base of the hash of a word and its inverse modulo 2 to the 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@cache
def _codes() -> np.ndarray:
    """A fixed 64-bit number per byte, the same for A-Z as for a-z."""
    return mix64(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64), 77)


@cache
def _powers(base: int) -> np.ndarray:
    return _more_powers(base, PIECE + 1)


def _more_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids of the words of texts that lie one after the other, A-Z lower-cased; and the number of words of each text.

    The id of a word is a polynomial over numbers of its bytes, scrambled. Sums over a whole piece give those of all its words.
    """
    solid = np.ones(len(data) + 1, bool)
    solid[:-1] = (data != 32) & ((data < 9) | (data > 13))
    solid[-1] = False
    first = np.empty(len(data) + 1, bool)
    first[0], first[1:] = True, ~solid[:-1]
    first[offsets] = True  # a text ends the word of the one before it
    last = np.append(first[1:] | ~solid[1:], True)
    starts, ends = np.flatnonzero(first & solid), np.flatnonzero(last & solid) + 1
    ids = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + PIECE, "right")))
        a, b, n = starts[at:to] - low, ends[at:to] - low, int(ends[to - 1] - low)
        up, down = (_powers(x) if n <= PIECE else _more_powers(x, n + 1) for x in (BASE, INVERSE))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_codes()[data[low:low + n]] * up[:n], out=sums[1:])
        ids[at:to] = mix64((sums[b] - sums[a]) * down[a], 3)
        at = to
    return ids, np.diff(np.searchsorted(starts, offsets))


@dataclass(frozen=True)
class Shingler:
    """Sorted distinct shingle ids of texts, A-Z lower-cased.

    A text with fewer words than a shingle is one shingle; one without words has none.
    """

    words: int

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets of all texts one after the other, and where each begins, with the end of the last one."""
        ids, lengths = word_ids(data, offsets)
        firsts = np.cumsum(lengths) - lengths
        counts = np.where(lengths >= self.words, lengths - self.words + 1, lengths > 0)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        found = np.empty(int(bounds[-1]), np.uint64)
        whole = np.repeat(lengths >= self.words, counts)
        # Windows of consecutive texts follow each other; those over the end of a text are left out.
        inside = np.ones(max(len(ids) - self.words + 1, 0), bool)
        for back in range(1, self.words):
            over = firsts[1:] - back
            inside[over[(over >= 0) & (over < len(inside))]] = False
        found[whole] = mix64(ngram_ids(ids, self.words)[inside], self.words)
        for n in range(1, self.words):
            short = np.flatnonzero(lengths == n)
            if len(short):
                windows = ids[firsts[short][:, None] + np.arange(n)].ravel()
                found[bounds[short]] = mix64(ngram_ids(windows, n)[::n], n)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            found[a:b].sort()
        new = np.ones(len(found), bool)
        new[1:] = found[1:] != found[:-1]
        new[bounds[:-1][counts > 0]] = True
        return found[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys, bytes and offsets of texts that are worked on together, from batches (key, text)."""
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string()).fill_null("")
        _, places, body = texts.buffers()
        offsets = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(body, np.uint8) if body else np.empty(0, np.uint8)
        ends, at = np.cumsum(np.maximum(np.diff(offsets), LEAST)), 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
            yield batch.column(0).slice(at, to - at), data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
            at = to


def prefix_length(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Two sets this similar share one of so many first tokens, under any common order."""
    return n - (percent * n + 99) // 100 + 1


def _smallest(s: np.ndarray, order: np.ndarray, bounds: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every set so many tokens, those that come first in an order; and where each text's begin."""
    kept = []
    for a, b, p in zip(bounds[:-1].tolist(), bounds[1:].tolist(), most.tolist()):
        if p < b - a:
            kept.append(s[a:b][np.argpartition(order[a:b], p - 1)[:p]])
        elif p:
            kept.append(s[a:b])
    return np.concatenate(kept).view(np.int64) if kept else np.empty(0, np.int64), np.concatenate([[0], np.cumsum(most)])


def _prefixes(s: np.ndarray, common: np.ndarray, seed: int, bounds: np.ndarray, percent: int) -> pa.ListArray:
    """The first tokens of every set under one order: common ones last, else by a seeded hash."""
    n = np.diff(bounds)
    order = common.astype(np.uint64) << np.uint64(63) | (mix64(s, seed) >> np.uint64(1))
    return _lists(*_smallest(s, order, bounds, np.where(n > 0, prefix_length(n, percent), 0)))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _first_tokens(shingler: Shingler, percent: int):
    """The first tokens of every text by the hash of the first order alone, one by one."""
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, *texts in _texts(batches):
            s, bounds = shingler.sets(*texts)
            n = np.diff(bounds)
            found, _ = _smallest(s, mix64(s, ORDERS[0]), bounds, np.minimum(n, LOOK * prefix_length(n, percent)))
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found)], ["token"])
    return run


def _signatures(shingler: Shingler, percent: int, common):
    """Rows (id, n, two digests, bitmap, prefix under the first order), one per text."""
    names = ["id", "n", "a", "b", *[f"m{i}" for i in range(BITMAP)], "p"]

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, *texts in _texts(batches):
            s, bounds = shingler.sets(*texts)
            n = np.diff(bounds)
            digests, full = np.zeros((2, len(keys)), np.uint64), n > 0
            if len(s):
                digests[0, full] = np.add.reduceat(mix64(s, 1), bounds[:-1][full])
                digests[1, full] = np.bitwise_xor.reduceat(mix64(s, 2), bounds[:-1][full])
            places = np.repeat(np.arange(len(keys)) * 64 * BITMAP, n) + (mix64(s, 5) >> np.uint64(55)).astype(np.int64)
            bits = (np.bincount(places, minlength=len(keys) * 64 * BITMAP) & 1).astype(np.uint8).reshape(len(keys), -1)
            bitmap = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(n), *map(pa.array, digests.view(np.int64)),
                 *[pa.array(np.ascontiguousarray(m)) for m in bitmap.T], _prefixes(s, common.value.holds(s), ORDERS[0], bounds, percent)], names)
    return run


def _postings(repeated):
    """(id, prefix) -> (id, token) of the tokens that may be in several prefixes."""
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(1)
            tokens = p.flatten().to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(len(p)), p.value_lengths().to_numpy(zero_copy_only=False))
            keep = repeated.value.holds(tokens.view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[keep])), pa.array(tokens[keep])], ["id", "token"])
    return run


def _only(ids):
    """The rows whose first column is in a filter."""
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(ids.value.holds(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))))
    return run


def _shingle_rows(shingler: Shingler, percent: int, common):
    """Rows (id, whole set, prefixes under the other orders)."""
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, *texts in _texts(batches):
            s, bounds = shingler.sets(*texts)
            last = common.value.holds(s)
            yield pa.RecordBatch.from_arrays([keys, _lists(s.view(np.int64), bounds),
                                              *[_prefixes(s, last, seed, bounds, percent) for seed in ORDERS[1:]]], ["id", "s", "p1", "p2"])
    return run


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id of the undirected ``links`` (a, b); comp is the smallest id reachable.

    Labels go to the neighbours and along the labels themselves until nothing changes; every
    round is checkpointed. Per id only the smallest label is kept before anything is sent.
    """
    both = hold(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = hold(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).select(F.col("a").alias("id"), "comp")
        jump = labels.alias("x").join(labels.alias("y"), F.expr("x.comp = y.id")).select("x.id", "y.comp")
        new = hold(labels.union(near).union(jump).groupBy("id").agg(F.min("comp").alias("comp")))
        old = labels.withColumnRenamed("comp", "before")
        same = not new.join(old, "id").filter("comp <> before").limit(1).count()
        release(labels)
        if same:
            release(both)
            return new
        labels = new


def _placed(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """``rows`` with the component of their id; an id without links is one."""
    return rows.drop("comp").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _with_hubs(rows: DataFrame) -> DataFrame:
    """The rows of tokens with more than ``HUBS`` components, with so many of the token's ids as hubs.

    Ids have one order, so that the tokens of alike sets choose the same hubs.
    """
    crowded = rows.groupBy("token").agg(F.countDistinct("comp").alias("comps")).filter(F.col("comps") > HUBS).select("token")
    rows = rows.join(crowded, "token", "left_semi").select("token", "id", "comp")
    first = Window.partitionBy("token").orderBy(F.xxhash64("id"), "id")
    hubs = (rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= HUBS)
            .groupBy("token").agg(F.sort_array(F.collect_list(F.struct("id", "comp"))).alias("hubs")))
    return rows.join(hubs, "token")


def _stars(rows: DataFrame) -> DataFrame:
    """Pairs of the hubs of a token and its sets of other components."""
    return (rows.select("id", "comp", "hubs").distinct()
            .select("id", F.explode(F.expr("filter(hubs, h -> h.comp <> comp)")).alias("hub"))
            .select(F.least("hub.id", "id").alias("a"), F.greatest("hub.id", "id").alias("b")).distinct())


def _between(rows: DataFrame, small: DataFrame, alike: Column) -> DataFrame:
    """Pairs (a, b) that share a token and lie in different components; few of them come more than once.

    Of two alike sets nearly all tokens are shared. If one of the last tokens before a token, in order of value, is shared
    too, the pair is left to that one, so the first shared token always gives it. Sets of the component with the
    most sets of a token are not compared with each other.
    """
    own = Window.partitionBy("id").orderBy("token")
    before = F.array_compact(F.array(*[F.lag("token", k).over(own) for k in range(1, BEFORE + 1)])).alias("before")
    rest = hold(rows.select("token", "id", "comp", "hub", before).join(small, "id"))
    main = (rest.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("sets")).groupBy("token")
            .agg(F.max(F.struct("sets", "comp")).alias("most"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
            .select("token", F.col("most.comp").alias("main")))
    x, y = rest.join(main, "token").filter("comp <> main AND id <> hub").alias("x"), rest.filter("id <> hub").alias("y")
    return (x.join(y, F.expr("x.token = y.token AND x.comp <> y.comp AND (y.comp = x.main OR x.id < y.id)")
                   & F.expr("NOT arrays_overlap(x.before, y.before)") & alike)
            .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")))


class _Search:
    """Filters and verification over the representatives of equal sets."""

    def __init__(self, docs: DataFrame, shingler: Shingler, percent: int, common, small: DataFrame) -> None:
        self.docs, self.percent, self.small = docs, percent, small
        self.rows = _shingle_rows(shingler, percent, common)

    def alike(self, x: str, y: str) -> Column:
        """Sizes and parity bitmaps allow the similarity.

        A bit of two bitmaps differs only where the sets differ, so the number of differing
        bits is at most the size of the symmetric difference.
        """
        q = self.percent
        differing = " + ".join(f"bit_count({x}.m{i} ^ {y}.m{i})" for i in range(BITMAP))
        return F.expr(f"100 * least({x}.n, {y}.n) >= {q} * greatest({x}.n, {y}.n) AND "
                      f"({differing}) * {100 + q} <= {100 - q} * ({x}.n + {y}.n)")

    def by_sizes(self, pairs: DataFrame) -> DataFrame:
        x, y = self.small.alias("x"), self.small.alias("y")
        return (pairs.join(x, F.expr("a = x.id")).join(y, F.expr("b = y.id")).filter(self.alike("x", "y"))
                .select("a", "b"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that share prefix tokens under all the other orders too and whose whole
        sets are similar enough."""
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        # The filter lets through all wanted texts and few others, so the rest are never shuffled.
        ids = self.docs.sparkSession.sparkContext.broadcast(BitFilter.of(wanted))
        sets = hold(self.docs.mapInArrow(_only(ids), "id long, t string").dropDuplicates(["id"])
                    .mapInArrow(self.rows, "id long, s array<long>, p1 array<long>, p2 array<long>"))
        ids.unpersist()  # the sets are written
        x, y = sets.alias("x"), sets.alias("y")
        common = (pairs.join(x, F.expr("a = x.id")).join(y, F.expr("b = y.id"))
                  .filter("arrays_overlap(x.p1, y.p1) AND arrays_overlap(x.p2, y.p2)").select(
                      "a", "b", F.size(F.array_intersect("x.s", "y.s")).cast("long").alias("i"),
                      (F.size("x.s") + F.size("y.s")).cast("long").alias("both")))
        found = hold(common.filter(F.expr(f"100 * i >= {self.percent} * (both - i)")).select("a", "b"))
        release(sets)
        return found


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5,
                    percent: int = 80) -> DataFrame:
    """``key``, n_shingles, component_id: one row per input row.

    Two texts link when 100 * |intersection| >= percent * |union| of their distinct shingles of
    ``words`` words; component_id is the smallest key reachable by links. Texts
    without words (null, empty, blank) have 0 shingles and are linked with nothing. Keys
    are whole numbers without nulls; rows that share a key must share the text. Extra columns are
    ignored, an empty table gives no rows.

    1. Equal sets are one class and go on as their smallest key.
    2. Tokens that are among the first ones of many texts come last in all orders; a bit filter
       of fixed size tells which. The orders differ in the hash of a token. Any filter gives
       right results.
    3. Sets that share a prefix token under the first order are compared with one hub of that
       token, its smallest key: as many pairs as sets. Sizes and bitmaps, then the prefixes
       under the other orders, strike out pairs before the whole sets are intersected.
    4. Tokens whose sets now all lie in one component are done, however many there are. The
       others with many components get ``HUBS`` more hubs, so a hub that is unlike the rest of a large group
       does not leave its pairs to the next step.
    5. For the tokens still open the pairs between different components follow, through the same filters.
    """
    spark = df.sparkSession
    docs = df.select(quoted(key).cast("long").alias("id"), quoted(text).alias("t"))
    shingler = Shingler(words)
    tokens = docs.mapInArrow(_first_tokens(shingler, percent), "token long").groupBy("token")
    often = tokens.agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > COMMON).select("token")
    common = spark.sparkContext.broadcast(BitFilter.of(often))
    del tokens, often
    forget(spark)  # what has been shuffled so far is not needed any more
    schema = ", ".join(["id long", "n long", "a long", "b long", *[f"m{i} long" for i in range(BITMAP)], "p array<long>"])
    signed = hold(docs.mapInArrow(_signatures(shingler, percent, common), schema))
    classes_of = signed.filter("n > 0").groupBy("n", "a", "b").agg(F.min("id").alias("rep"))
    member = hold(signed.select("id", "n", "a", "b").join(classes_of, ["n", "a", "b"], "left").select(
        "id", "n", F.coalesce("rep", "id").alias("rep")))
    copies = member.filter("id <> rep").select("id").distinct()
    alone = signed.filter("n > 0").join(copies, "id", "left_anti")
    small = hold(alone.select("id", "n", *[f"m{i}" for i in range(BITMAP)]).dropDuplicates(["id"]))
    search = _Search(docs, shingler, percent, common, small)

    prefixes = signed.filter("n > 0").select("id", "p")
    twice = (prefixes.select(F.explode("p").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
             .filter("df > 1").select("token"))
    repeated = spark.sparkContext.broadcast(BitFilter.of(twice))
    postings = hold(prefixes.mapInArrow(_postings(repeated), "id long, token long")
                    .join(copies, "id", "left_anti").distinct())
    del twice
    forget(spark)
    release(signed)
    hubs = postings.groupBy("token").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub < last")
    shared = hold(postings.join(hubs.select("token", "hub"), "token"))
    release(postings)
    stars = shared.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = search.verified(hold(search.by_sizes(stars)))
    del hubs, stars
    forget(spark)
    comp = components(links)
    placed = _placed(shared, comp)
    mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    rest = hold(placed.join(mixed.select("token"), "token", "left_semi"))
    release(shared)
    del placed, mixed
    links = links.union(search.verified(hold(search.by_sizes(_stars(_with_hubs(rest))))))
    comp = components(links)
    forget(spark)
    cross = hold(_between(_placed(rest, comp), small, search.alike("x", "y")).distinct())
    release(rest)
    forget(spark)
    more = search.verified(cross)
    final = components(links.union(more))
    for sent in (common, repeated):  # their tables are written
        sent.unpersist()
    return (member.join(final.withColumnRenamed("id", "rep"), "rep", "left")
            .select(F.col("id").alias(key), F.col("n").alias("n_shingles"),
                    F.coalesce("comp", "rep").alias("component_id")))
