"""Small helpers shared by the text operators."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import gc
import re
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.session import forget, work_folder

#: Words are maximal runs of anything but the six ASCII white space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TO_SPACE = str.maketrans("\t\n\x0b\x0c\r", "     ")
#: Entries a worker keeps in a per-word cache before it starts a new one.
CACHE_ENTRIES = 400_000
#: Longest word that such a cache keeps, so its entries bound its bytes.
LONGEST_KEPT = 64
#: Folder of the tables an application has written, by its id.
_FOLDERS: dict[str, str] = {}
#: Path of each table that is held, as long as the driver knows the table.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Folder below it for the tables of the step that runs at the moment.
_GROUP: contextvars.ContextVar[str] = contextvars.ContextVar("group", default="")


def words_of(text: str | None) -> list[str]:
    """The words of a text; none for null."""
    return [w for w in text.translate(_TO_SPACE).split(" ") if w] if text else []


def fold(key: str, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo ``folds``; fold 0 is held out."""
    return F.crc32(quoted(key).cast("string").cast("binary")) % folds


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (wrapping arithmetic)."""
    x = (x ^ np.uint64(seed)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Return freed memory of a Python worker to the machine; workers are used again for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library can
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of a task that returns its memory at the end, when its last batches are gone too."""
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()
    return whole


class WordIds(dict):
    """word -> stable 64-bit id, remembered while a task meets the word again."""

    def __missing__(self, word: str) -> int:
        import xxhash
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= LONGEST_KEPT:
            self[word] = value
        return value

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ngram_ids(ids: np.ndarray, n: int) -> np.ndarray:
    """Ids of the n-grams of a sequence of ids; empty if it is shorter than n."""
    count = len(ids) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(count, np.uint64)
    for j in range(n):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + ids[j:j + count]
        acc ^= acc >> np.uint64(29)
    return mix64(acc)


def by_bytes(rows: Iterable[tuple], size, limit: int) -> Iterator[list[tuple]]:
    """Lists of consecutive rows of about ``limit`` bytes; a larger row stands alone."""
    held, total = [], 0
    for row in rows:
        n = size(row)
        if held and total + n > limit:
            yield held
            held, total = [], 0
        held.append(row)
        total += n
    if held:
        yield held


def text_batches(batches: Iterable[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[list[tuple]]:
    """(key, text) lists of bounded size from Arrow batches whose last column is the text."""
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(batch.num_columns - 1)
        rows = ((k, t.as_py()) for k, t in zip(keys, texts))
        yield from by_bytes(rows, lambda r: 16 + len(r[1] or ""), limit)


def hold(df: DataFrame, *folders: str) -> DataFrame:
    """Compute a table once: write it to the shared folder of the session and read it again.

    A lost executor costs none of it, and the planner knows its true size afterwards. ``folders``
    are columns with few values; a filter on them reads only the files it needs. The tables of a
    session are removed when it ends, or before by ``release``.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{_GROUP.get()}{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def release(*tables: DataFrame) -> None:
    """Remove tables that ``hold`` returned. Nothing that is still to be computed may read them."""
    for table in tables:
        _remove(table.sparkSession, _PATHS.pop(table))


@contextlib.contextmanager
def own_tables(spark: SparkSession, group: str) -> Iterator[None]:
    """Keep the tables that are held inside together, and first remove those of the last time.

    For steps that follow each other: when one begins, what the one before it returned has been
    written and nothing reads its tables any more. Shuffle files of frames that are gone are removed
    when the driver collects garbage, so that is asked for.
    """
    _remove(spark, f"{_folder(spark)}/{group}")
    forget(spark)
    token = _GROUP.set(f"{group}/")
    try:
        yield
    finally:
        _GROUP.reset(token)


def _folder(spark: SparkSession) -> str:
    """One folder per application below the shared one."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{work_folder(spark)}/tables-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class BitFilter:
    """A set of 64-bit values in a bit vector of fixed size. Members are always found; others seldom."""

    BITS, CHUNK, SEEDS = 1 << 27, 1 << 20, (101, 211)

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @classmethod
    def places(cls, values: np.ndarray) -> list[np.ndarray]:
        return [mix64(values, seed) & np.uint64(cls.BITS - 1) for seed in cls.SEEDS]

    def holds(self, values: np.ndarray) -> np.ndarray:
        """Whether each value may be a member."""
        live = np.arange(len(values))
        for seed in self.SEEDS:
            at = mix64(values[live], seed) & np.uint64(self.BITS - 1)
            live = live[(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        found = np.zeros(len(values), bool)
        found[live] = True
        return found

    @classmethod
    def of(cls, values: DataFrame) -> BitFilter:
        """The filter of a one-column table of longs; tasks send parts, of fixed size in all."""
        parts = (values.mapInArrow(_bit_places, "chunk long, body binary").repartition("chunk")
                 .mapInArrow(_merge_bits, "chunk long, body binary"))
        bits = np.zeros(cls.BITS >> 3, np.uint8)
        for r in parts.collect():  # BITS bits in all, whatever the table holds
            at = r["chunk"] * cls.CHUNK >> 3
            bits[at:at + (cls.CHUNK >> 3)] |= np.frombuffer(r["body"], np.uint8)
        return cls(bits)


def _bit_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, sorted places inside it) per batch."""
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        at = np.unique(np.concatenate(BitFilter.places(values)))
        chunks, first = np.unique(at // np.uint64(BitFilter.CHUNK), return_index=True)
        inside = (at % np.uint64(BitFilter.CHUNK)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunks.astype(np.int64)), pa.array([x.tobytes() for x in np.split(inside, first[1:])] if len(at) else [], pa.binary())],
            ["chunk", "body"])


def _merge_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, its bits) from the places sent by all tasks. One task may get all chunks, so they are held as bits."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if chunk not in held:
                held[chunk] = np.zeros(BitFilter.CHUNK >> 3, np.uint8)
            at = np.frombuffer(body, np.uint32)
            np.bitwise_or.at(held[chunk], at >> np.uint32(3), np.uint8(1) << (at & np.uint32(7)).astype(np.uint8))
    for chunk, bits in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["chunk", "body"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str,
                    per_class: int, max_bytes: int) -> DataFrame:
    """(key, text, y): up to ``per_class`` labelled training rows of either class.

    Rows of the held-out fold never enter. The rows with the smallest key hashes are taken,
    so the sample does not depend on the partitions. Texts over ``max_bytes`` only serve
    for scoring. Labels that contradict each other for a key are left out.
    """
    known = (labels.select(quoted(key).alias("k"), quoted(label).cast("int").alias("y"))
             .filter("k IS NOT NULL AND y IN (0, 1)").groupBy("k")
             .agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").drop("top")
             .filter(fold("k") != 0))
    found = docs.select(quoted(key).alias("k"), F.coalesce(quoted(text), F.lit("")).alias("t"))
    sizes = (found.filter(F.octet_length("t") <= max_bytes).select("k", F.xxhash64("k").alias("h"))
             .join(known, "k"))
    chosen = [sizes.filter(F.col("y") == y).orderBy("h", "k").limit(per_class) for y in (0, 1)]
    wanted = chosen[0].unionByName(chosen[1]).select("k", "y").distinct()
    # At most 2 * per_class keys: small by the parameter, whatever the tables hold.
    return (found.filter(F.octet_length("t") <= max_bytes).join(F.broadcast(wanted), "k")
            .groupBy("k").agg(F.min("t").alias("t"), F.min("y").alias("y")))
