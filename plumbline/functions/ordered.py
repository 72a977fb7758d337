"""Exact ranks, cumulative sums and order statistics without a global window.

A window without a partition key pulls its input into one task. Here every
value is first mapped to a bucket by a fixed, order-preserving function of the
value alone. Totals per bucket are small and give each bucket its offset; only
the order inside a bucket is worked out by a window, so the work spreads over
as many tasks as there are buckets. The bucket function depends on no sample
or sketch, so recomputing a lost partition always yields the same buckets.

Of a table large enough for it, buckets are counted first and those with too many
rows are split by finer steps of the same function until none is left or the steps
tell all values apart, so values packed into a narrow range are spread as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.session import materialize, small_side

#: Bits of the mantissa and of a hash that the first buckets tell apart, and that every refinement adds.
VALUE_BITS, HASH_BITS, MORE_BITS = 12, 10, 12
#: Rows a bucket may hold. A table of fewer bytes than that has no larger one and is not counted.
MOST_ROWS = 4_000_000
#: Bits of a mantissa that bucket numbers have room for: 2200 exponents and the sign take the others.
_ROOM = 48


def with_value_bucket(df: DataFrame, name: str, out: str = "__bucket", bits: int = VALUE_BITS) -> DataFrame:
    """Add the monotone bucket number of a double column: exponent and the first ``bits`` of the mantissa.

    Numbers of any ``bits`` can be compared: a finer bucket lies between its coarse one and the next.
    The exponent is a projection of its own, so its logarithm is taken once per row.
    """
    v = f"double(`{name}`)"
    bits = min(bits, _ROOM)
    step = f"floor((abs({v}) / power(2D, __exponent) - 1D) * {2.0 ** bits!r}D) * {1 << (_ROOM - bits)}"
    size = (f"(CASE WHEN abs({v}) >= 1e308D THEN {1 << 60}L "
            f"ELSE (__exponent + 1100) * {1 << _ROOM} + {step} + 1 END)")
    sign = f"CASE WHEN {v} > 0D THEN 1 ELSE -1 END"
    return (df.withColumn("__exponent", F.expr(f"floor(log2(abs({v})))"))
            .withColumn(out, F.expr(f"bigint(CASE WHEN {v} = 0D THEN 0 ELSE {size} * {sign} END)"))
            .drop("__exponent"))


def with_hash_bucket(df: DataFrame, name: str, out: str = "__bucket", bits: int = HASH_BITS) -> DataFrame:
    """Add the monotone bucket number of a uniformly distributed long: its first ``bits``."""
    rest = 64 - min(bits, 64)
    return df.withColumn(out, F.shiftleft(F.shiftright(quoted(name), rest), rest).cast("long"))


def _bucketed(df: DataFrame, value: str, keys: Sequence[str], by_hash: bool) -> DataFrame:
    """Add ``__bucket``, refined where one holds more than ``MOST_ROWS`` rows."""
    return _counted(df, value, keys, by_hash)[0]


def _counted(df: DataFrame, value: str, keys: Sequence[str], by_hash: bool) -> tuple[DataFrame, DataFrame]:
    """The rows with ``__bucket``, refined where one holds more than ``MOST_ROWS`` rows, and ``__size`` per (keys, bucket).

    The sizes that tell whether to refine are written, so who needs them doesn't read the rows again.
    """
    place, bits, most = (with_hash_bucket, HASH_BITS, 64) if by_hash else (with_value_bucket, VALUE_BITS, _ROOM)
    on = [*keys, "__bucket"]

    def sizes(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*[quoted(k) for k in on]).agg(F.count(F.lit(1)).alias("__size"))

    out = place(df, value, bits=bits)
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= MOST_ROWS:
        return out, sizes(out)
    counts = materialize(sizes(out))
    while bits < most:
        full = small_side(counts.filter(F.col("__size") > MOST_ROWS).withColumn("__full", F.lit(True)).drop("__size"))
        if full.first() is None:
            break
        bits += MORE_BITS
        finer = place(_null_safe_left(out, full, on), value, "__finer", bits)
        out = finer.withColumn("__bucket", F.when(F.col("__full"), F.col("__finer")).otherwise(F.col("__bucket"))).drop(
            "__full", "__finer")
        counts = materialize(sizes(out))
    return out, counts


def _null_safe_left(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    cond = " AND ".join(f"`{c}` <=> `__r_{c}`" for c in on)
    return left.join(renamed, F.expr(cond), "left").drop(*[f"__r_{c}" for c in on])


def running_totals(df: DataFrame, value: str, sums: dict[str, Column], keys: Sequence[str] = (),
                   by_hash: bool = False) -> DataFrame:
    """One row per (keys, value), in value order, with exact cumulative sums.

    For every entry of ``sums`` (integer-valued, null counts as 0) the result holds
    the sum at the value itself (``name``), over all smaller values
    (``name_before``) and over the whole key (``name_total``). Null values are
    left out.
    """
    keys = list(keys)
    names = list(sums)
    kept = df.filter(quoted(value).isNotNull()).select(
        *[quoted(k) for k in keys], quoted(value),
        *[F.coalesce(e, F.lit(0)).cast("long").alias(s) for s, e in sums.items()])
    kept = _bucketed(kept, value, keys, by_hash)
    per_value = kept.groupBy(*[quoted(k) for k in [*keys, value]], "__bucket").agg(
        *[F.sum(s).alias(s) for s in names])
    per_bucket = per_value.groupBy(*[quoted(k) for k in keys], "__bucket").agg(
        *[F.sum(s).alias(s) for s in names])
    # One row per bucket (at most octaves * resolution per key) carries what lies before
    # it. It enters the window as the first row of its bucket, so no join is needed.
    group = Window.partitionBy(*[quoted(k) for k in keys], F.lit(0))
    before = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = per_bucket.select(
        *[quoted(k) for k in keys], F.lit(None).cast(kept.schema[value].dataType).alias(value), "__bucket",
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(s) for s in names],
        *[F.sum(s).over(group).alias(f"{s}_total") for s in names], F.lit(0).alias("__kind"))
    rows = per_value.select(
        *[quoted(k) for k in keys], quoted(value), "__bucket", *names,
        *[F.lit(None).cast("long").alias(f"{s}_total") for s in names], F.lit(1).alias("__kind"))
    inside = (Window.partitionBy(*[quoted(k) for k in keys], "__bucket").orderBy("__kind", quoted(value))
              .rowsBetween(Window.unboundedPreceding, -1))
    return heads.unionByName(rows).select(
        *[quoted(k) for k in keys], quoted(value), "__kind", *names,
        *[F.sum(s).over(inside).alias(f"{s}_before") for s in names],
        *[F.first(f"{s}_total", ignorenulls=True).over(inside).alias(f"{s}_total") for s in names],
    ).filter("__kind = 1").drop("__kind")


def _null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join in which null keys match each other, keeping the left key columns."""
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    cond = " AND ".join(f"`{c}` <=> `__r_{c}`" for c in on)
    return left.join(renamed, F.expr(cond), "inner").drop(*[f"__r_{c}" for c in on])


def order_statistics(df: DataFrame, value: str, ranks: Column, keys: Sequence[str] = (),
                     by_hash: bool = False) -> DataFrame:
    """Values at given 0-based ranks: rows ``(keys, n, rank, value)``.

    ``ranks`` is an array<bigint> expression over ``n`` (the non-null count of the
    key) and the keys. Only rows of the buckets that hold a wanted rank are
    shuffled; all others are merely counted.
    """
    keys = list(keys)
    kcols = [quoted(k) for k in keys]
    kept, counts = _counted(df.filter(quoted(value).isNotNull()).select(*kcols, quoted(value)), value, keys, by_hash)
    # The bucket table holds at most (octaves * resolution) rows per key.
    group = Window.partitionBy(*kcols, F.lit(0))
    placed = counts.select(
        "*", F.coalesce(F.sum("__size").over(group.orderBy("__bucket").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"),
        F.sum("__size").over(group).alias("n"))
    here = F.filter(F.array_distinct(ranks), lambda r: (r >= F.col("__start"))
                    & (r < F.col("__start") + F.col("__size")))
    targets = placed.withColumn("__ranks", here).filter(F.size("__ranks") > 0).drop("__size")
    # Per key there are as many targets as wanted ranks. With features as the only key
    # that is a handful; for keys taken from the data the size is checked.
    targets = F.broadcast(targets) if set(keys) <= {"feature"} else small_side(targets)
    hits = _null_safe_join(kept, targets, [*keys, "__bucket"])
    per_value = hits.groupBy(*kcols, "__bucket", "n", "__start", "__ranks", quoted(value)).agg(
        F.count(F.lit(1)).alias("__size"))
    inside = (Window.partitionBy(*kcols, "__bucket").orderBy(quoted(value))
              .rowsBetween(Window.unboundedPreceding, -1))
    ranked = per_value.withColumn(
        "__first", F.col("__start") + F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    return (ranked.select(*kcols, "n", quoted(value), "__first", "__size",
                          F.explode("__ranks").alias("rank"))
            .filter((F.col("rank") >= F.col("__first"))
                    & (F.col("rank") < F.col("__first") + F.col("__size")))
            .select(*kcols, "n", "rank", quoted(value)))


def quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles: one row per key, ``(keys, n, q)``.

    ``q`` is an array aligned with ``probs``.
    """
    keys = list(keys)
    kcols = [quoted(k) for k in keys]

    ranks = F.expr("array(" + ", ".join(
        f"bigint({f}((n - 1) * {float(p)!r}D))" for p in probs for f in ("floor", "ceil")) + ")")
    stats = order_statistics(df, value, ranks, keys)
    by_rank = stats.groupBy(*kcols, "n").agg(
        F.map_from_entries(F.collect_list(F.struct("rank", quoted(value)))).alias("__at"))

    def interpolate(p: float) -> str:
        h = f"((n - 1) * {float(p)!r}D)"
        lo = f"element_at(__at, bigint(floor({h})))"
        hi = f"element_at(__at, bigint(ceil({h})))"
        return f"{lo} + ({hi} - {lo}) * ({h} - floor({h}))"

    return by_rank.select(*kcols, "n", F.expr(f"array({', '.join(interpolate(p) for p in probs)})").alias("q"))


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                     keys: Sequence[str] = ()) -> DataFrame:
    """Quantiles of several numeric columns: ``(keys, feature, n, q)``."""
    from plumbline.functions.columns import melt
    long = melt(df, cols, [quoted(k) for k in keys], as_number=True)
    return quantiles(long, "value", probs, [*keys, "feature"])
