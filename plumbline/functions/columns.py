"""Building blocks shared by the operators.

Per-column statistics are computed as one wide aggregation (a single scan, one
row per group) and only the tiny result is turned into one row per feature;
rows are unpivoted only where values themselves have to be grouped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_column(c: str | Column) -> Column:
    return quoted(c) if isinstance(c, str) else c


def missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating-point column: the one rule of all operators."""
    x = quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def number(c: str | Column) -> Column:
    """Double where the value is a number; NaN and unparsable text become null."""
    x = as_column(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b as double; null (or ``default``) where b is zero or null."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over pairs known on both sides; null where a side is constant.

    (The built-in raises on zero variance under ANSI arithmetic.)
    """
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in skip]


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def per_column(df: DataFrame, cols: Sequence[str], build: Callable[[str], dict[str, Column]],
               keys: Sequence[str] = (), name: str = "feature") -> DataFrame:
    """One row per (keys, column): aggregates of every column from a single scan."""
    structs = [
        F.struct(F.lit(c).alias(name), *[e.alias(a) for a, e in build(c).items()]) for c in cols
    ]
    agg = df.groupBy(*keys).agg(F.array(*structs).alias("__cols"))
    return agg.select(*keys, F.inline("__cols"))


def melt(df: DataFrame, cols: Sequence[str], keep: Sequence[str | Column] = (),
         as_number: bool = False) -> DataFrame:
    """Long form ``(keep…, feature, value)``: numbers as double, all else as string."""
    def cast(c: str) -> Column:
        return number(c) if as_number else quoted(c).cast("string")
    kept = df.select(*keep).columns
    if not set(kept) & {*cols, "feature", "value"}:
        wide = df.select(*keep, *[cast(c).alias(c) for c in cols])
        return wide.unpivot([quoted(k) for k in kept], [quoted(c) for c in cols], "feature", "value")
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), cast(c).alias("value")) for c in cols])
    return df.select(*keep, F.inline(pairs))


def value_counts(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (),
                 sums: dict[str, Column] | None = None) -> DataFrame:
    """Rows ``(keys, feature, value, count, …)``; nulls form their own value.

    Counting before anything else lets map-side partial aggregation absorb hot
    values, so a value holding a third of the rows reaches the shuffle as one row
    per task.
    """
    sums = sums or {}
    keep = [*keys, *[e.alias(a) for a, e in sums.items()]]
    return (melt(df, cols, keep).groupBy(*keys, "feature", "value")
            .agg(F.count(F.lit(1)).alias("count"), *[F.sum(a).alias(a) for a in sums]))


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row DataFrame to every row by scalar subquery."""
    packed = one_row.select(F.struct(*one_row.columns).alias("__scalars"))
    return (df.withColumn("__scalars", packed.scalar())
            .select(*[quoted(c) for c in df.columns],
                    *[F.col(f"__scalars.`{c}`").alias(c) for c in one_row.columns]))


def decision_tree_index(name: str, edges: Sequence[float], inclusive: bool = True) -> Column:
    """``decision_tree_sql`` as a column."""
    return F.expr(decision_tree_sql(name, edges, inclusive))


def decision_tree_sql(name: str, edges: Sequence[float], inclusive: bool = True) -> str:
    """Number of sorted literal ``edges`` that are <= the column (< if not inclusive).

    Written as a balanced CASE tree: log2(n) comparisons per row, all inside
    generated code, instead of joining each row with every edge.
    """
    op = ">=" if inclusive else ">"

    def build(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return (f"CASE WHEN `{name}` {op} {float(edges[mid])!r}D THEN {build(mid + 1, hi)} "
                f"ELSE {build(lo, mid)} END")
    return build(0, len(edges))
