"""Comparison of two versions of a table and of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import number, quoted, ratio
from plumbline.operators.contract import lenient_target


def compare_relationships(train: DataFrame, holdout: DataFrame, value: str,
                          signed: bool = True) -> DataFrame:
    """Full outer join on feature of one statistic in two tables, with its change.

    ``signed`` adds whether the direction agrees.
    """
    a = distinct_rows(train, ["feature"], ["feature"]).select("feature", quoted(value).alias("train"))
    b = distinct_rows(holdout, ["feature"], ["feature"]).select("feature", quoted(value).alias("holdout"))
    out = a.join(b, "feature", "full_outer").withColumn("delta", F.col("holdout") - F.col("train"))
    out = out.withColumn("abs_delta", F.abs("delta"))
    if signed:
        out = out.withColumn("same_direction", F.signum("train") == F.signum("holdout"))
    return out


def label_disagreement(a: DataFrame, b: DataFrame, ident: str, target: str) -> DataFrame:
    """Shared ids, ids with a readable label on both sides, and how many labels disagree."""
    left = a.select(quoted(ident).cast("string").alias("__id"), lenient_target(target).alias("ya"))
    right = b.select(quoted(ident).cast("string").alias("__id"), lenient_target(target).alias("yb"))
    both = F.col("ya").isNotNull() & F.col("yb").isNotNull()
    differ = F.count_if(F.col("ya") != F.col("yb"))
    return left.join(right, "__id").agg(
        F.count(F.lit(1)).alias("shared_rows"), F.count_if(both).alias("compared_rows"),
        differ.alias("disagreements"), ratio(differ, F.count_if(both), 0.0).alias("disagreement_rate"))


def shared_row_diff(a: DataFrame, b: DataFrame, ident: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Differing values per common column over ids found in both tables.

    A column counts as numeric when more than 95 % of both sides parse as numbers;
    then numbers are compared where both exist, otherwise texts (null as text). Both
    counts are taken in the same pass and the fitting one is kept.
    """
    common = [c for c in (cols or a.columns) if c in b.columns and c in a.columns and c != ident]
    left = a.select(quoted(ident).cast("string").alias("__id"),
                    *[quoted(c).alias(f"a_{c}") for c in common])
    right = b.select(quoted(ident).cast("string").alias("__id"),
                     *[quoted(c).alias(f"b_{c}") for c in common])

    def stats(c: str) -> Column:
        x, y = quoted(f"a_{c}"), quoted(f"b_{c}")
        nx, ny = number(x), number(y)
        tx, ty = (F.coalesce(z.cast("string"), F.lit("null")) for z in (x, y))
        return F.struct(F.lit(c).alias("feature"), F.count(F.lit(1)).alias("shared_rows"),
                        F.count(nx).alias("na"), F.count(ny).alias("nb"),
                        F.count_if(nx != ny).alias("num_diff"), F.count_if(tx != ty).alias("text_diff"))

    rows = left.join(right, "__id").agg(F.array(*[stats(c) for c in common]).alias("r")).select(F.inline("r"))
    numeric = (F.col("na") > F.col("shared_rows") * 0.95) & (F.col("nb") > F.col("shared_rows") * 0.95)
    diff = F.when(numeric, F.col("num_diff")).otherwise(F.col("text_diff"))
    return rows.select("feature", "shared_rows", diff.alias("different_values"),
                       ratio(diff, F.col("shared_rows")).alias("difference_rate"))


def row_overlap(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct keys (an id, or all common columns) on each side, shared and exclusive.

    One union and one grouped count replace separate intersect and except queries.
    """
    keys = [quoted(c).cast("string").alias(c) for c in cols]
    both = (a.select(*keys, F.lit(1).alias("__a"), F.lit(0).alias("__b"))
            .unionByName(b.select(*keys, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
            .groupBy(*[quoted(c) for c in cols]).agg(F.max("__a").alias("a"), F.max("__b").alias("b")))
    in_a, in_b = F.sum("a"), F.sum("b")
    shared = F.count_if((F.col("a") == 1) & (F.col("b") == 1))
    return both.agg(
        in_a.alias("distinct_a"), in_b.alias("distinct_b"), shared.alias("shared"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"),
        ratio(shared, in_a, 0.0).alias("overlap_of_a"), ratio(shared, in_b, 0.0).alias("overlap_of_b"))


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of either table with types, positions and what differs."""
    spark = a.sparkSession
    schema = "column string, type string, position int"
    left = spark.createDataFrame([(c, t, i) for i, (c, t) in enumerate(a.dtypes)], schema)
    right = spark.createDataFrame([(c, t, i) for i, (c, t) in enumerate(b.dtypes)], schema)
    l, r = left.alias("l"), right.alias("r")
    status = (F.when(F.col("r.type").isNull(), "only_in_a").when(F.col("l.type").isNull(), "only_in_b")
              .when(F.col("l.type") != F.col("r.type"), "type_differs").otherwise("same"))
    return l.join(r, F.col("l.column") == F.col("r.column"), "full_outer").select(
        F.coalesce("l.column", "r.column").alias("column"), F.col("l.type").alias("type_a"),
        F.col("r.type").alias("type_b"), F.col("l.position").alias("position_a"),
        F.col("r.position").alias("position_b"), status.alias("status"),
        F.coalesce(F.col("l.position") == F.col("r.position"), F.lit(False)).alias("same_position"))


def paired_split_compare(results: DataFrame, key: str, a: str, b: str, metric: str,
                         split: str = "split", by: Sequence[str] = ()) -> DataFrame:
    """Compare variant b with a on the same splits: wins, ties and metric change.

    One row per fitted split enters, so exact percentiles stay small.
    """
    on = [*by, split]
    left = results.filter(quoted(key) == a).select(*on, quoted(metric).alias("ma"))
    right = results.filter(quoted(key) == b).select(*on, quoted(metric).alias("mb"))
    d = F.col("mb") - F.col("ma")
    return left.join(right, on).groupBy(*by).agg(
        F.count(F.lit(1)).alias("splits"), F.avg((d > 0).cast("double")).alias("better_share"),
        F.avg((d >= 0).cast("double")).alias("equal_or_better_share"), F.avg(d).alias("mean_delta"),
        F.percentile(d, F.lit(0.5)).alias("median_delta"), F.min(d).alias("min_delta"),
        F.max(d).alias("max_delta"))


def attach_metrics(performance: DataFrame, extra: DataFrame, on: Sequence[str] = ("method",)) -> DataFrame:
    """Left join further metrics by method."""
    return performance.join(extra, list(on), "left")


def union_results(*tables: DataFrame) -> DataFrame:
    """Stack result tables by column name; columns missing in one become null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def distinct_rows(df: DataFrame, subset: Sequence[str] | None = None,
                  order: Sequence[str] | None = None) -> DataFrame:
    """Drop duplicate rows, or keep the first row by ``order`` per subset.

    The first row is found by a mergeable minimum, not by sorting each group, so a
    key holding a large share of the rows is reduced before the shuffle.
    """
    if not subset:
        return df.distinct()
    rest = [c for c in df.columns if c not in subset]
    sort = [c for c in (order or rest) if c not in subset]
    sort += [c for c in rest if c not in sort]
    if not sort:
        return df.select(*[quoted(c) for c in subset]).distinct()
    first = F.min(F.struct(*[quoted(c) for c in sort])).alias("__first")
    return df.groupBy(*[quoted(c) for c in subset]).agg(first).select(
        *[quoted(c) if c in subset else F.col(f"__first.`{c}`").alias(c) for c in df.columns])


def holdout_percentile(results: DataFrame, fixed: DataFrame, metric: str, key: str = "model") -> DataFrame:
    """Share of repeated scores below the fixed hold-out score, per model."""
    f = fixed.select(key, quoted(metric).alias("fixed_score"))
    m = quoted(metric)
    return results.join(f, key).groupBy(key, "fixed_score").agg(
        F.count(F.lit(1)).alias("splits"), F.avg(m).alias("mean_score"),
        F.avg((m < F.col("fixed_score")).cast("double")).alias("share_below_fixed"))


def align_predictions(a: DataFrame, b: DataFrame, threshold_a: float, threshold_b: float,
                      on: Sequence[str] = ("id",), label: str = "y", score: str = "p") -> DataFrame:
    """Scores of two methods for the same rows side by side, joined by key, with both flags."""
    left = a.select(*on, quoted(label).alias("y"), quoted(score).alias("p_a"))
    right = b.select(*on, quoted(score).alias("p_b"))
    return left.join(right, list(on)).withColumns({
        "flag_a": (F.col("p_a") >= F.lit(threshold_a)).cast("int"),
        "flag_b": (F.col("p_b") >= F.lit(threshold_b)).cast("int")})
