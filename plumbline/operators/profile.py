"""Profiles of a table: structure, missingness, distributions and target rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import (
    attach_scalars, categorical_columns, decision_tree_index, melt, missing, number, numeric_columns,
    per_column, quoted, ratio, value_counts,
)
from plumbline.functions.ordered import column_quantiles
from plumbline.session import small_side


def _row_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))


def table_structure(df: DataFrame, ident: str) -> DataFrame:
    """Rows, columns, duplicate rows and ids, missing cells and their share."""
    gaps = sum([F.count_if(missing(df, c)) for c in df.columns], F.lit(0))
    base = df.agg(F.count(F.lit(1)).alias("rows"), gaps.cast("long").alias("missing_cells"))
    dup = _row_counts(df).agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))
    ids = df.groupBy(quoted(ident).alias("__id")).agg(F.count(F.lit(1)).alias("__n")).agg(
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_ids"))
    width = len(df.columns)
    return attach_scalars(attach_scalars(base, dup), ids).select(
        "rows", F.lit(width).alias("columns"), "duplicate_rows", "duplicate_ids", "missing_cells",
        (ratio(F.col("missing_cells"), F.col("rows") * width, 0.0) * 100).alias("missing_percent"))


def duplicate_audit(df: DataFrame) -> DataFrame:
    """Whole-row duplicates: extra copies, rows in any duplicate group, number of groups."""
    many = F.col("__n") > 1
    return _row_counts(df).agg(
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates_keep_first"),
        F.coalesce(F.sum(F.when(many, F.col("__n"))), F.lit(0)).alias("duplicates_all_members"),
        F.count_if(many).alias("duplicate_groups"))


def id_audit(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Per id column: distinct values, repeated rows and missing values."""
    n = F.col("count")
    known = F.col("value").isNotNull()
    return value_counts(df, ids).groupBy("feature").agg(
        F.count("value").alias("unique_count"), F.sum(n - 1).alias("duplicate_count"),
        F.sum(F.when(~known, n).otherwise(0)).alias("missing_count"))


def missingness(df: DataFrame, cols: Sequence[str] | None = None, top: int | None = None) -> DataFrame:
    """Missing count and share per column, most affected first (``top`` columns if given)."""
    cols = list(cols or df.columns)
    out = per_column(df, cols, lambda c: {
        "missing": F.count_if(missing(df, c)), "rows": F.count(F.lit(1))})
    out = out.withColumn("missing_percent", ratio(F.col("missing"), F.col("rows"), 0.0) * 100)
    return out.orderBy(F.desc("missing"), "feature").limit(top) if top else out


def missing_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with any missing value, complete rows and missing cells in total."""
    gaps = sum([missing(df, c).cast("int") for c in (cols or df.columns)], F.lit(0))
    return df.agg(F.count_if(gaps > 0).alias("rows_with_any_missing"),
                  F.count_if(gaps == 0).alias("complete_rows"),
                  F.coalesce(F.sum(gaps), F.lit(0)).alias("missing_cells"))


def _unique_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return (melt(df, cols, as_number=True).filter(F.col("value").isNotNull())
            .groupBy("feature", "value").agg(F.lit(1).alias("one"))
            .groupBy("feature").agg(F.count(F.lit(1)).alias("unique_values")))


def numeric_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, missing, unique, moments, exact quartiles, zero and negative counts."""
    cols = list(cols or numeric_columns(df))
    base = per_column(df, cols, lambda c: {
        "count": F.count(number(c)), "missing": F.count_if(number(c).isNull()),
        "mean": F.avg(number(c)), "std": F.stddev_samp(number(c)), "min": F.min(number(c)),
        "max": F.max(number(c)), "zero_count": F.count_if(number(c) == 0),
        "negative_count": F.count_if(number(c) < 0)})
    q = column_quantiles(df, cols, [0.25, 0.5, 0.75]).select(
        "feature", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))
    return (base.join(q, "feature", "left").join(_unique_numbers(df, cols), "feature", "left")
            .withColumn("unique_values", F.coalesce("unique_values", F.lit(0))))


def categorical_profile(df: DataFrame, cols: Sequence[str] | None = None,
                        top: int | None = None) -> DataFrame:
    """Count and share per value, nulls kept; ``top`` limits the report per column."""
    cols = list(cols or categorical_columns(df))
    counts = value_counts(df, cols)
    totals = df.agg(F.count(F.lit(1)).alias("__rows"))
    out = attach_scalars(counts, totals).select(
        "feature", "value", "count",
        (ratio(F.col("count"), F.col("__rows")) * 100).alias("percent"))
    if top is None:
        return out
    # A rank filter right above the window lets Spark keep only the best rows per task.
    w = Window.partitionBy("feature").orderBy(F.desc("count"), F.asc_nulls_last("value"))
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def category_extremes(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Number of categories, most and least common value with count and share."""
    cols = list(cols or categorical_columns(df))
    known = value_counts(df, cols).filter(F.col("value").isNotNull())
    first = F.struct(-F.col("count"), F.col("value"))
    last = F.struct(F.col("count"), F.col("value"))
    total = F.sum("count")
    return known.groupBy("feature").agg(
        F.count(F.lit(1)).alias("categories"),
        F.min_by("value", first).alias("most_common"), F.max("count").alias("most_common_count"),
        F.min_by("value", last).alias("least_common"), F.min("count").alias("least_common_count"),
        (ratio(F.max("count"), total) * 100).alias("most_common_percent"),
        (ratio(F.min("count"), total) * 100).alias("least_common_percent"))


def feature_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Type, missing and unique values (null counts as a value) per column."""
    cols = list(cols or df.columns)
    types = dict(df.dtypes)
    type_of = F.create_map(*[F.lit(x) for c in cols for x in (c, types[c])])
    n = F.col("count")
    return value_counts(df, cols).groupBy("feature").agg(
        F.sum(F.when(F.col("value").isNull(), n).otherwise(0)).alias("missing"),
        F.count(F.lit(1)).alias("unique_values"),
        (ratio(F.count(F.lit(1)), F.sum(n)) * 100).alias("unique_percent"),
    ).withColumn("data_type", F.element_at(type_of, F.col("feature")))


def randomness_indicators(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Unique ratio, whether all values look like integers, mean and std."""
    cols = list(cols or numeric_columns(df))

    def whole(c: str) -> Column:
        x = number(c)
        return F.abs(x - F.rint(x)) <= 1e-8 + 1e-5 * F.abs(F.rint(x))

    base = per_column(df, cols, lambda c: {
        "count": F.count(number(c)), "integer_like": F.bool_and(whole(c)),
        "mean": F.avg(number(c)), "std": F.stddev_samp(number(c))})
    return (base.filter(F.col("count") > 0).join(_unique_numbers(df, cols), "feature")
            .select("feature", ratio(F.col("unique_values"), F.col("count")).alias("unique_ratio"),
                    "integer_like", "mean", "std"))


def variance_audit(df: DataFrame, cols: Sequence[str] | None = None, share: float = 0.95) -> DataFrame:
    """Constant columns and columns dominated by one value (nulls count as a value)."""
    cols = list(cols or df.columns)
    top = ratio(F.max("count"), F.sum("count"))
    return value_counts(df, cols).groupBy("feature").agg(
        F.count(F.lit(1)).alias("unique_values"), top.alias("top_share"),
        (F.count(F.lit(1)) <= 1).alias("constant"),
        ((F.count(F.lit(1)) > 1) & (top >= F.lit(share))).alias("near_constant"))


def target_summary(df: DataFrame, target: str, pos: str, neg: str,
                   expected: float | None = None) -> DataFrame:
    """Class counts, positive rate, missing and unexpected labels, distance to an expected rate."""
    t = quoted(target).cast("string")
    n, p = F.count(F.lit(1)), F.count_if(t == pos)
    out = df.agg(
        n.alias("rows"), p.alias("positive_count"), F.count_if(t == neg).alias("negative_count"),
        F.count_if(t.isNull()).alias("missing_count"),
        F.count_if(~t.isin(pos, neg)).alias("unexpected_count"), ratio(p, n).alias("positive_rate"))
    if expected is None:
        return out
    return out.withColumn("delta_pp", (F.col("positive_rate") - F.lit(expected)) * 100)


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Count and share per target value, null included."""
    counts = df.groupBy(quoted(target).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return attach_scalars(counts, df.agg(F.count(F.lit(1)).alias("__rows"))).select(
        "value", "count", (ratio(F.col("count"), F.col("__rows")) * 100).alias("percent"))


def target_entropy(df: DataFrame, target: str) -> DataFrame:
    """Shannon entropy of the target distribution in bits."""
    share = class_counts(df, target).select((F.col("percent") / 100).alias("s"), "count")
    return share.agg(F.sum("count").alias("rows"), F.sum(-F.col("s") * F.log2("s")).alias("entropy_bits"))


def rate_by_category(df: DataFrame, cats: Sequence[str], y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per (feature, category): rows, positives, rate in %, deviation from the overall rate.

    The overall rate comes from the already aggregated counts, joined back as one row
    per feature, so the table is read once and no window spans a feature's categories.
    """
    label = quoted(y).cast("long")
    counts = value_counts(df.filter(quoted(y).isNotNull()), cats, keys, {"positives": label})
    totals = counts.groupBy(*[quoted(k) for k in keys], "feature").agg(
        ratio(F.sum("positives"), F.sum("count")).alias("overall"))
    # Without keys: one row per feature.
    totals = small_side(totals) if keys else F.broadcast(totals)
    rate = ratio(F.col("positives"), F.col("count"))
    return counts.join(totals, [*keys, "feature"]).select(
        *[quoted(k) for k in keys], "feature", F.col("value").alias("category"),
        F.col("count").alias("total"), "positives", (rate * 100).alias("rate_percent"),
        ((rate - F.col("overall")) * 100).alias("deviation_pp"))


def numeric_by_class(df: DataFrame, nums: Sequence[str], target: str, digits: int = 2) -> DataFrame:
    """Count, mean, median, std, min, max of each number per target value."""
    keyed = df.filter(quoted(target).isNotNull())
    base = per_column(keyed, nums, lambda c: {
        "count": F.count(number(c)), "mean": F.avg(number(c)), "std": F.stddev_samp(number(c)),
        "min": F.min(number(c)), "max": F.max(number(c))}, [target])
    med = column_quantiles(keyed, nums, [0.5], [target]).select(
        quoted(target), "feature", F.col("q")[0].alias("median"))
    out = base.join(med, [target, "feature"], "left")
    return out.withColumns({c: F.bround(F.col(c), digits) for c in ("mean", "median", "std", "min", "max")})


def quantile_edges(df: DataFrame, nums: Sequence[str], bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Quantile edges ``q`` (bins + 1 values, repeats kept): ``(keys, feature, n, q)``."""
    return column_quantiles(df, nums, [i / bins for i in range(bins + 1)], keys)


def bin_label(bins: int, value: str = "value", q: str = "q") -> Column:
    """Label of the right-closed bin of a value; the first bin also holds its lower edge.

    The label is the number of edges below the value, repeats included, so that equal
    edges collapse without building a list per row; see :func:`bin_position`.
    """
    below = " + ".join(f"int({q}[{i}] < {value})" for i in range(bins + 1))
    first = " + ".join(f"int({q}[{i}] <= {q}[0])" for i in range(bins + 1))
    return F.expr(f"greatest({below}, {first})")


def bin_position(label: str, q: str = "q") -> Column:
    """0-based position of a bin label among the distinct edges."""
    return F.expr(f"size(array_distinct(slice({q}, 1, {label}))) - 1")


def rate_by_quantile(df: DataFrame, nums: Sequence[str], y: str, bins: int = 4) -> DataFrame:
    """Positive rate per quantile bin, with the bin bounds and the distance to the overall rate."""
    labelled = df.filter(quoted(y).isNotNull())
    # One row per feature, each bins + 1 edges wide.
    edges = quantile_edges(labelled, nums, bins).filter("size(array_distinct(q)) > 1").select("feature", "q")
    long = melt(labelled, nums, [quoted(y).cast("long").alias("y")], as_number=True).filter(
        F.col("value").isNotNull())
    counts = long.join(F.broadcast(edges), "feature").groupBy("feature", bin_label(bins).alias("__label")).agg(
        F.count(F.lit(1)).alias("count"), F.sum("y").alias("positives"))
    binned = counts.join(F.broadcast(edges), "feature").select(
        "feature", bin_position("__label").alias("bin"), "count", "positives",
        F.array_distinct("q").alias("edges"))
    overall = labelled.agg(F.avg(quoted(y)).alias("overall_rate"))
    rate = ratio(F.col("positives"), F.col("count"))
    return attach_scalars(binned, overall).select(
        "feature", "bin", F.col("edges")[F.col("bin")].alias("lower"),
        F.col("edges")[F.col("bin") + 1].alias("upper"), "count", "positives",
        rate.alias("rate"), "overall_rate", (rate - F.col("overall_rate")).alias("rate_difference"))


def quantile_rate_range(rates: DataFrame) -> DataFrame:
    """Lowest and highest bin rate per feature and their distance in percentage points."""
    return rates.groupBy("feature").agg(
        (F.min("rate") * 100).alias("lowest_rate"), (F.max("rate") * 100).alias("highest_rate"),
        ((F.max("rate") - F.min("rate")) * 100).alias("rate_range_pp"))


def interaction_rates(df: DataFrame, pairs: Sequence[tuple[str, str]], y: str) -> DataFrame:
    """Positive rate per combination of two features; numbers are split at their median."""
    names = sorted({c for p in pairs for c in p})
    nums = [c for c in names if c in numeric_columns(df)]
    base = df.select(*[quoted(c) for c in names], quoted(y).cast("long").alias("__y")).filter(
        F.col("__y").isNotNull())
    if nums:
        med = column_quantiles(base, nums, [0.5]).groupBy().agg(
            *[F.max(F.when(F.col("feature") == c, F.col("q")[0])).alias(f"__median_{c}") for c in nums])
        base = attach_scalars(base, med)

    def level(c: str) -> Column:
        if c in nums:
            return F.when(number(c) <= F.col(f"`__median_{c}`"), "Low").otherwise("High")
        return F.coalesce(quoted(c).cast("string"), F.lit("null"))

    combos = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                                F.concat_ws(" | ", level(a), level(b)).alias("interaction_group"))
                       for a, b in pairs])
    return (base.select("__y", F.inline(combos))
            .groupBy("feature_a", "feature_b", "interaction_group")
            .agg(F.count(F.lit(1)).alias("count"), F.avg("__y").alias("rate")))


def interaction_range(rates: DataFrame) -> DataFrame:
    return rates.groupBy("feature_a", "feature_b").agg(
        F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"),
        (F.max("rate") - F.min("rate")).alias("rate_range"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency counts ``(a, b, count)`` over rows where both are known."""
    return (df.filter(quoted(a).isNotNull() & quoted(b).isNotNull())
            .groupBy(quoted(a).cast("string").alias("a"), quoted(b).cast("string").alias("b"))
            .agg(F.count(F.lit(1)).alias("count")))


def split_summary(results: DataFrame, keys: Sequence[str], metrics: Sequence[str],
                  floor: float = 0.60) -> DataFrame:
    """Spread of metrics over splits: one row per (keys, metric).

    Input holds one row per fitted split, so exact in-memory percentiles are bounded
    by the number of splits of a key.
    """
    rows = melt(results, metrics, [quoted(k) for k in keys], as_number=True)
    v = F.col("value")
    return rows.groupBy(*[quoted(k) for k in keys], F.col("feature").alias("metric")).agg(
        F.count(v).alias("splits"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, F.lit(0.5)).alias("median"),
        F.percentile(v, F.lit(0.1)).alias("p10"), F.percentile(v, F.lit(0.9)).alias("p90"),
        F.avg((v < F.lit(floor)).cast("double")).alias("share_below_floor"))


def signal_concentration(num: DataFrame, cat: DataFrame) -> DataFrame:
    """Strongest signals: ``num(feature, abs_r)``, ``cat(feature, cramers_v, max_deviation)``."""
    r = F.col("abs_r")
    a = num.agg(F.coalesce(F.max(r), F.lit(0.0)).alias("max_abs_r"),
                F.count_if(r >= 0.05).alias("features_ge_005"),
                F.count_if(r >= 0.10).alias("features_ge_010"))
    b = cat.agg(F.coalesce(F.max("cramers_v"), F.lit(0.0)).alias("max_cramers_v"),
                F.coalesce(F.max("max_deviation"), F.lit(0.0)).alias("max_category_deviation"))
    return attach_scalars(a, b)


def importance_concentration(importance: DataFrame, tops: Sequence[int] = (5, 10)) -> DataFrame:
    """Share of positive importance held by the leading features (one row per feature)."""
    w = Window.orderBy(F.desc("importance"), "feature")
    kept = importance.select("feature", "importance", F.row_number().over(w).alias("rank"),
                             F.greatest("importance", F.lit(0.0)).alias("__pos"))
    return kept.agg(*[
        ratio(F.sum(F.when(F.col("rank") <= k, F.col("__pos")).otherwise(0.0)), F.sum("__pos"), 0.0)
        .alias(f"top_{k}_share") for k in tops])


def probability_stats(pred: DataFrame, score: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """Min, max, mean, population std and exact percentiles of a score."""
    from plumbline.functions.ordered import quantiles
    probs = [0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]
    x = number(score)
    keyed = pred.select(*[quoted(k) for k in keys], x.alias("value"))
    base = keyed.groupBy(*keys).agg(F.count("value").alias("rows"), F.min("value").alias("min"),
                                    F.max("value").alias("max"), F.avg("value").alias("mean"),
                                    F.stddev_pop("value").alias("std"))
    q = quantiles(keyed, "value", probs, keys).select(
        *keys, *[F.col("q")[i].alias(f"p{round(p * 100):02d}") for i, p in enumerate(probs)])
    return base.join(q, list(keys), "left") if keys else attach_scalars(base, q)


def histogram(df: DataFrame, nums: Sequence[str], bins: int = 20) -> DataFrame:
    """Equal-width histogram counts over each column's own range, empty bins included."""
    span = per_column(df, nums, lambda c: {"lo": F.min(number(c)), "hi": F.max(number(c))})
    span = span.filter(F.col("lo").isNotNull())
    long = melt(df, nums, as_number=True).filter(F.col("value").isNotNull())
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.when(F.col("hi") == F.col("lo"), 0).otherwise(
        F.least(F.floor(F.try_divide(F.col("value") - F.col("lo"), width)), F.lit(bins - 1))).cast("int")
    counts = long.join(F.broadcast(span), "feature").groupBy("feature", index.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))  # span: one row per feature
    frame = span.select("feature", "lo", "hi", F.explode(
        F.array(*[F.lit(i) for i in range(bins)])).alias("bin"))
    return frame.join(counts, ["feature", "bin"], "left").select(
        "feature", "bin", (F.col("lo") + width * F.col("bin")).alias("lower"),
        (F.col("lo") + width * (F.col("bin") + 1)).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"))


def box_summary(df: DataFrame, nums: Sequence[str], target: str) -> DataFrame:
    """Five-number summary per class with whiskers at 1.5 interquartile ranges.

    Whiskers are the outermost values inside the fences; one more pass over the
    columns finds them once the quartiles are known.
    """
    keyed = df.filter(quoted(target).isNotNull())
    q = column_quantiles(keyed, nums, [0.0, 0.25, 0.5, 0.75, 1.0], [target]).select(
        quoted(target), "feature", *[F.col("q")[i].alias(n) for i, n in
                                     enumerate(("min", "q25", "median", "q75", "max"))])
    iqr = F.col("q75") - F.col("q25")
    fences = q.withColumns({"lo_fence": F.col("q25") - 1.5 * iqr, "hi_fence": F.col("q75") + 1.5 * iqr})
    v = F.col("value")
    inside = (v >= F.col("lo_fence")) & (v <= F.col("hi_fence"))
    long = melt(keyed, nums, [quoted(target)], as_number=True).filter(v.isNotNull())
    bounds = small_side(fences.select(target, "feature", "lo_fence", "hi_fence"))
    whisk = (long.join(bounds, [target, "feature"])
             .groupBy(quoted(target), "feature")
             .agg(F.min(F.when(inside, v)).alias("whisker_low"),
                  F.max(F.when(inside, v)).alias("whisker_high"),
                  F.count_if(~inside).alias("outliers")))
    return q.join(whisk, [target, "feature"])


def score_histogram(pred: DataFrame, label: str = "y", score: str = "p", bins: int = 20) -> DataFrame:
    """Equal-width counts of scores in [0, 1] per class."""
    edges = [i / bins for i in range(1, bins)]
    return pred.groupBy(quoted(label).cast("int").alias("y"),
                        decision_tree_index(score, edges).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))


def dataset_profile(tables: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """One record per candidate table: ``{name: (df, target, positive, negative)}``.

    Rows, columns, content fingerprint, duplicates, missing cells and target rate.
    """
    from plumbline.sources.fingerprint import content_fingerprint
    out = None
    for name, (df, target, pos, neg) in tables.items():
        one = target_summary(df, target, pos, neg).select("rows", "positive_count", "positive_rate")
        one = attach_scalars(one, duplicate_audit(df).select("duplicates_keep_first"))
        one = attach_scalars(one, missing_rows(df).select("missing_cells", "rows_with_any_missing"))
        one = attach_scalars(one, content_fingerprint(df).select("schema_hash", "content_hash"))
        one = one.select(F.lit(name).alias("dataset"), F.lit(len(df.columns)).alias("columns"), "*")
        out = one if out is None else out.unionByName(one)
    return out
