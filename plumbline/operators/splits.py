"""Keyed, class-stratified splits.

Every row gets a pseudo-random position from a hash of its key and a seed; a split
is a range of positions. The range bounds of each class are exact order
statistics, so split sizes are exact, yet rows are neither sorted, moved nor copied: the
bounds of all seeds are found from counts of (class, position) and then compared
with in a narrow projection, which gives every row an array with its place per seed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.functions.digests import digest_positions
from plumbline.functions.ordered import order_statistics
from plumbline.session import small_side

_LOWEST = -(2 ** 63)
#: From so many positions a row on, working them out costs more than sending the row to a free core.
MANY = 8


def position(ids: Sequence[str], seed: int | Column) -> Column:
    """Pseudo-random position of a row, uniform over all longs."""
    s = seed if isinstance(seed, Column) else F.lit(seed)
    return F.xxhash64(s.cast("long"), *[quoted(c) for c in ids])


def portable_position(ids: Sequence[str], seed: int | Column) -> Column:
    """The same idea from an MD5 digest, which other engines can reproduce."""
    s = seed if isinstance(seed, Column) else F.lit(seed)
    text = F.concat_ws("-", s.cast("string"), *[quoted(c).cast("string") for c in ids])
    # 60 bits of the digest, spread over the full range of longs for bucketing.
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") - F.lit(1 << 59)) * 16


def _places(place: Callable[[Sequence[str], Column], Column], ids: Sequence[str], seeds: Sequence[int]) -> Column:
    """Array of the positions per seed, one expression for all: code with one for each is too long to be compiled.

    Digests for many seeds are worked out for a block of rows at a time, see ``digests``.
    """
    if place is portable_position and len(seeds) >= MANY:
        return digest_positions(F.concat_ws("-", F.lit(""), *[quoted(c).cast("string") for c in ids]), seeds)
    return F.transform(F.array(*[F.lit(s).cast("long") for s in seeds]), lambda s: place(ids, s))


def _with_bounds(df: DataFrame, y: str, places: Column, ranks: list[Column], many: bool = False) -> DataFrame:
    """Add arrays ``__places`` and ``__bounds``: per place the positions found at the wanted ranks of the
    class, the lowest possible position where the rank is negative. Rows without a label are left out."""
    base = df.withColumn("__class", quoted(y).cast("string")).filter(F.col("__class").isNotNull()).withColumn(
        "__places", places)
    if many:  # a small file is read by few tasks
        spark = df.sparkSession
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        base = base.drop("__places").repartition(tasks).withColumn("__places", places)
    long = base.select("__class", F.posexplode("__places").alias("__seed", "__pos"))
    found = order_statistics(long, "__pos", F.array(*ranks), ["__seed", "__class"], by_hash=True)
    by_rank = found.groupBy("__seed", "__class", "n").agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "__pos"))).alias("__at"))
    bounds = F.array(*[F.when(r < 0, F.lit(_LOWEST)).otherwise(F.try_element_at("__at", r)) for r in ranks])
    per_class = by_rank.select("__class", F.struct("__seed", bounds.alias("bounds")).alias("__one")).groupBy("__class").agg(
        F.transform(F.array_sort(F.collect_list("__one")), lambda x: x["bounds"]).alias("__bounds"))
    return base.join(small_side(per_class), "__class").drop("__class")


def _below() -> Column:
    """Array of the number of bounds below the position, per place."""
    return F.zip_with("__places", "__bounds", lambda p, found: F.size(F.filter(found, lambda b: b < p)))


def _holdout_rank(frac: float) -> Column:
    return (F.floor(F.col("n") * F.lit(frac) + 0.5) - 1).cast("long")


def stratified_holdout(df: DataFrame, y: str, ids: Sequence[str], frac: float = 0.2, seed: int = 42,
                       pos: Column | None = None, out: str = "is_holdout") -> DataFrame:
    """Mark round(frac * n) rows of every class as hold-out."""
    base = _with_bounds(df, y, F.array(position(ids, seed) if pos is None else pos), [_holdout_rank(frac)])
    return base.withColumn(out, _below()[0] == 0).drop("__places", "__bounds")


def _fold_ranks(k: int) -> list[Column]:
    return [(F.floor(F.col("n") * F.lit(f) / F.lit(k)) - 1).cast("long") for f in range(1, k)]


def stratified_kfold(df: DataFrame, y: str, ids: Sequence[str], k: int = 5, seed: int = 42,
                     pos: Column | None = None) -> DataFrame:
    """Add ``fold`` 0..k-1; per class the fold sizes differ by at most one."""
    base = _with_bounds(df, y, F.array(position(ids, seed) if pos is None else pos), _fold_ranks(k))
    return base.withColumn("fold", _below()[0]).drop("__places", "__bounds")


def fold_table(df: DataFrame, y: str, ids: Sequence[str], k: int = 5, seeds: Sequence[int] = (42, 52, 62, 72, 82),
               portable: bool = False) -> DataFrame:
    """Add ``folds``: an array with the fold of the row per seed. One row per row."""
    place = portable_position if portable else position
    base = _with_bounds(df, y, _places(place, ids, seeds), _fold_ranks(k), len(seeds) >= MANY)
    return base.withColumn("folds", _below()).drop("__places", "__bounds")


def repeated_stratified_kfold(df: DataFrame, y: str, ids: Sequence[str], k: int = 5,
                              seeds: Sequence[int] = (42, 52, 62, 72, 82), portable: bool = False) -> DataFrame:
    """``fold_table`` in long form: ``repeat``, ``fold`` and ``split`` = repeat * k + fold per (row, repeat)."""
    folds = fold_table(df, y, ids, k, seeds, portable)
    return folds.select(*[quoted(c) for c in df.columns], F.posexplode("folds").alias("repeat", "fold")).withColumn(
        "split", F.col("repeat") * k + F.col("fold"))


def holdout_table(df: DataFrame, y: str, ids: Sequence[str], n: int = 50, frac: float = 0.2, seed: int = 42,
                  portable: bool = False) -> DataFrame:
    """Add ``holdouts``: an array that tells for each of n splits whether the row is held out. One row per row."""
    place = portable_position if portable else position
    base = _with_bounds(df, y, _places(place, ids, range(seed, seed + n)), [_holdout_rank(frac)], n >= MANY)
    return base.withColumn("holdouts", F.transform(_below(), lambda b: b == 0)).drop("__places", "__bounds")


def repeated_holdout(df: DataFrame, y: str, ids: Sequence[str], n: int = 50, frac: float = 0.2,
                     seed: int = 42, portable: bool = False) -> DataFrame:
    """``holdout_table`` in long form: one row per (row, split) with ``is_holdout``."""
    place = portable_position if portable else position
    base = _with_bounds(df, y, _places(place, ids, range(seed, seed + n)), [_holdout_rank(frac)], n >= MANY)
    # The place and the bound of one split are compared after the arrays are taken apart, which is compiled code.
    one = base.select(*[quoted(c) for c in df.columns], "__bounds", F.posexplode("__places").alias("split", "__pos"))
    return one.withColumn("is_holdout", ~F.coalesce(F.col("__bounds")[F.col("split")][0] < F.col("__pos"), F.lit(False))).drop("__bounds", "__pos")
