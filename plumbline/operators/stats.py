"""Relations between features and a binary target, and drift between two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import (
    attach_scalars, correlation, melt, number, per_column, quoted, ratio, value_counts,
)
from plumbline.functions.ordered import running_totals
from plumbline.functions.tails import chi2_pvalue, kolmogorov_pvalue, normal_pvalue, t_pvalue
from plumbline.operators.profile import bin_label, quantile_edges, rate_by_category
from plumbline.session import materialize, small_side


def point_biserial(df: DataFrame, nums: Sequence[str], y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson r of a 0/1 label with each number, class means and two-sided t p-value.

    One scan for all features. A constant feature gets r = 0 and p = 1.
    """
    label = number(y)

    def stats(c: str) -> dict[str, Column]:
        x = F.when(label.isNotNull(), number(c))
        pair_y = F.when(x.isNotNull(), label)
        return {"n": F.count(x), "mean_0": F.avg(F.when(label == 0, x)),
                "mean_1": F.avg(F.when(label == 1, x)), "__lo": F.min(x), "__hi": F.max(x),
                "__ylo": F.min(pair_y), "__yhi": F.max(pair_y), "__r": correlation(x, pair_y)}

    base = per_column(df, nums, stats, keys)
    flat = (F.col("__lo") == F.col("__hi")) | (F.col("__ylo") == F.col("__yhi"))
    r = F.when(F.col("n") > 0, F.when(flat | (F.col("n") < 2), F.lit(0.0)).otherwise(F.col("__r")))
    dof = (F.col("n") - 2).cast("double")
    out = base.withColumn("r", r)
    t = F.col("r") * F.sqrt(ratio(dof, F.lit(1.0) - F.col("r") * F.col("r")))
    p = (F.when(flat, F.lit(1.0)).when(F.abs("r") >= 1.0, F.lit(0.0)).otherwise(t_pvalue(t, dof)))
    return out.select(*keys, "feature", "n", "mean_0", "mean_1",
                      (F.col("mean_1") - F.col("mean_0")).alias("mean_difference"), "r",
                      F.abs("r").alias("abs_r"), p.alias("p_value"))


def _labelled_long(df: DataFrame, nums: Sequence[str], y: str) -> DataFrame:
    return melt(df, nums, [number(y).cast("long").alias("y")], as_number=True).filter(
        F.col("value").isNotNull() & F.col("y").isNotNull())


def _class_ranks(df: DataFrame, nums: Sequence[str], y: str) -> DataFrame:
    """Per (feature, distinct value): rows, positives and the average rank of its ties."""
    long = _labelled_long(df, nums, y)
    ranked = running_totals(long, "value", {"n": F.lit(1), "pos": F.col("y")}, ["feature"])
    return ranked.withColumn("rank", F.col("n_before") + (F.col("n") + 1) / 2.0)


def spearman(df: DataFrame, nums: Sequence[str], y: str) -> DataFrame:
    """Rank correlation of each number with the 0/1 label, average ranks for ties."""
    r = _class_ranks(df, nums, y)
    n, s, p, c = F.col("total"), F.col("sr"), F.col("pos"), F.col("spr")
    agg = r.groupBy("feature").agg(
        F.sum("n").alias("total"), F.sum("pos").alias("pos"),
        F.sum(F.col("n") * F.col("rank")).alias("sr"),
        F.sum(F.col("n") * (F.col("rank") - F.col("n_total") / 2.0) ** 2).alias("srr"),
        F.sum(F.col("n") * (F.col("rank") - F.col("n_total") / 2.0)).alias("sc"),
        F.sum(F.col("pos") * (F.col("rank") - F.col("n_total") / 2.0)).alias("spr"))
    # Ranks are centred by n/2 before squaring to keep the sums well conditioned.
    cov = c - F.col("sc") * p / n
    var_r = F.col("srr") - F.col("sc") * F.col("sc") / n
    var_y = p - p * p / n
    rho = F.coalesce(ratio(cov, F.sqrt(var_r * var_y)), F.lit(0.0))
    return agg.select("feature", n.alias("n"), rho.alias("spearman"), F.abs(rho).alias("abs_spearman"))


def standardized_mean_diff(df: DataFrame, nums: Sequence[str], y: str) -> DataFrame:
    """(mean1 - mean0) over the pooled sample std, weighted by n - 1."""
    label = number(y)

    def stats(c: str) -> dict[str, Column]:
        out = {}
        for k in (0, 1):
            x = F.when(label == k, number(c))
            out |= {f"n_{k}": F.count(x), f"mean_{k}": F.avg(x), f"var_{k}": F.var_samp(x)}
        return out

    n0, n1 = F.col("n_0"), F.col("n_1")
    pooled = F.sqrt(ratio((n0 - 1) * F.col("var_0") + (n1 - 1) * F.col("var_1"), n0 + n1 - 2))
    return per_column(df, nums, stats).select(
        "feature", "mean_0", "mean_1", pooled.alias("pooled_std"),
        F.coalesce(ratio(F.col("mean_1") - F.col("mean_0"), pooled), F.lit(0.0)).alias("smd"))


def mann_whitney(df: DataFrame, nums: Sequence[str], y: str) -> DataFrame:
    """U of the class-0 sample and its two-sided normal p-value with tie and continuity correction."""
    r = _class_ranks(df, nums, y)
    t = F.col("n").cast("double")
    agg = r.groupBy("feature").agg(
        F.max("n_total").cast("double").alias("n"), F.max("pos_total").cast("double").alias("n1"),
        F.sum((F.col("n") - F.col("pos")) * F.col("rank")).alias("rank_sum_0"),
        F.sum(t * t * t - t).alias("ties"))
    n, n1 = F.col("n"), F.col("n1")
    n0 = n - n1
    u = F.col("rank_sum_0") - n0 * (n0 + 1) / 2
    sd = F.sqrt(n0 * n1 / 12 * (n + 1 - ratio(F.col("ties"), n * (n - 1))))
    z = ratio(F.abs(u - n0 * n1 / 2) - 0.5, sd)
    return agg.select("feature", n0.cast("long").alias("n_0"), n1.cast("long").alias("n_1"),
                      u.alias("u_statistic"),
                      F.least(F.lit(1.0), normal_pvalue(F.greatest(z, F.lit(0.0)))).alias("p_value"))


def chi_square_cramers_v(df: DataFrame, cats: Sequence[str], y: str, yates: bool = True,
                         bias_correction: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """Chi-square of each category against a target of any number of classes, with Cramér's V.

    Works on the grouped counts: row and column totals are joined to the observed
    cells, and cells that do not occur enter through their expected count alone, so
    no cross product of categories and classes is built.
    """
    keys = list(keys)
    known = df.filter(quoted(y).isNotNull())
    cells = (melt(known, cats, [*[quoted(k) for k in keys], quoted(y).cast("string").alias("y")])
             .filter(F.col("value").isNotNull())
             .groupBy(*keys, "feature", "value", "y").agg(F.count(F.lit(1)).alias("o")))
    cells = materialize(cells)  # the data are read once; all else works on the counts
    rows = cells.groupBy(*keys, "feature", "value").agg(F.sum("o").alias("r"))
    cols = cells.groupBy(*keys, "feature", "y").agg(F.sum("o").alias("c"))
    row_stats = rows.groupBy(*keys, "feature").agg(
        F.sum("r").alias("n"), F.count(F.lit(1)).alias("n_rows"))
    col_stats = cols.groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("n_cols"))
    shape = small_side(cols.join(row_stats.join(col_stats, [*keys, "feature"]), [*keys, "feature"]))
    full = cells.join(rows, [*keys, "feature", "value"]).join(shape, [*keys, "feature", "y"])
    e = F.col("r") * F.col("c") / F.col("n")
    diff = F.abs(F.col("o") - e)
    two_by_two = (F.col("n_rows") == 2) & (F.col("n_cols") == 2)
    shift = F.when(F.lit(yates) & two_by_two, F.least(F.lit(0.5), diff)).otherwise(F.lit(0.0))
    # An absent cell contributes (e - shift)^2 / e; summed without building it:
    # the expected counts of all cells add up to n.
    seen = full.groupBy(*keys, "feature").agg(
        F.sum((diff - shift) ** 2 / e).alias("seen"), F.sum(e).alias("seen_e"),
        F.count(F.lit(1)).alias("seen_cells"), F.max("n").alias("n"),
        F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"),
        F.min("r").alias("min_r"), F.min("c").alias("min_c"))
    absent_e = F.col("n") - F.col("seen_e")
    absent_cells = F.col("n_rows") * F.col("n_cols") - F.col("seen_cells")
    # In a 2 x 2 table at most two cells are absent; their expected counts follow from
    # the margins, and a table with an absent diagonal has equal expected counts there.
    each = ratio(absent_e, absent_cells, 0.0)
    absent = F.when(absent_cells == 0, F.lit(0.0)).when(
        F.lit(yates) & two_by_two,
        absent_cells * ratio((each - F.least(F.lit(0.5), each)) ** 2, each, 0.0)
    ).otherwise(absent_e)
    n, nr, nc = (F.col(x).cast("double") for x in ("n", "n_rows", "n_cols"))
    proper = (nr >= 2) & (nc >= 2)
    chi2 = F.when(proper, F.col("seen") + absent).otherwise(F.lit(0.0))
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    out = seen.withColumn("chi2", chi2).withColumn("dof", F.when(proper, dof).otherwise(0).cast("long"))
    phi2 = F.col("chi2") / n
    if bias_correction:
        phi2 = F.greatest(F.lit(0.0), phi2 - ratio((nc - 1) * (nr - 1), n - 1, 0.0))
        nr, nc = nr - ratio((nr - 1) ** 2, n - 1, 0.0), nc - ratio((nc - 1) ** 2, n - 1, 0.0)
    room = F.least(nr - 1, nc - 1)
    v = F.when(proper & (room > 0), F.sqrt(ratio(phi2, room, 0.0))).otherwise(F.lit(0.0))
    return out.select(*keys, "feature", F.col("n").cast("long").alias("n"), "chi2", "dof",
                      v.alias("cramers_v"),
                      F.when(F.col("dof") > 0, chi2_pvalue(F.col("chi2"), F.col("dof").cast("double")))
                      .otherwise(F.lit(1.0)).alias("p_value"))


def _sides(a: DataFrame, b: DataFrame, cols: Sequence[str], as_number: bool) -> DataFrame:
    """Both tables in long form with ``side`` 0 for a and 1 for b."""
    left = melt(a, cols, [F.lit(0).alias("side")], as_number)
    return left.unionByName(melt(b, cols, [F.lit(1).alias("side")], as_number))


def ks_two_sample(a: DataFrame, b: DataFrame, nums: Sequence[str]) -> DataFrame:
    """Largest distance between two empirical distributions, with means, medians and stds.

    The p-value uses the asymptotic Kolmogorov distribution.
    """
    long = _sides(a, b, nums, True).filter(F.col("value").isNotNull())
    steps = running_totals(long, "value", {"a": (F.col("side") == 0).cast("int"),
                                           "b": (F.col("side") == 1).cast("int")}, ["feature"])
    # Distances and both medians come out of the same cumulative counts.
    at = ("max(CASE WHEN {s}_before <= {r} AND {r} < {s}_before + {s} THEN value END)")
    median = " + ".join(at.format(s="{s}", r=f"{f}(({{s}}_total - 1) / 2)") for f in ("floor", "ceil"))
    d = steps.groupBy("feature").agg(
        F.expr("max(abs(try_divide(double(a_before + a), a_total) - try_divide(double(b_before + b), b_total))) AS ks_statistic"),
        F.expr("max(a_total) AS n_a"), F.expr("max(b_total) AS n_b"),
        *[F.expr(f"({median.format(s=s)}) / 2 AS median_{s}") for s in ("a", "b")])
    out = None
    for side, df in (("a", a), ("b", b)):
        m = per_column(df, nums, lambda c: {f"mean_{side}": F.avg(number(c)),
                                            f"std_{side}": F.stddev_pop(number(c))})
        out = m if out is None else out.join(m, "feature")
    en = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    return d.join(out, "feature").select(
        "feature", "n_a", "n_b", "ks_statistic",
        kolmogorov_pvalue(en * F.col("ks_statistic")).alias("p_value"),
        *[F.col(f"{m}_{s}") for m in ("mean", "median", "std") for s in ("a", "b")],
        *[(F.col(f"{m}_b") - F.col(f"{m}_a")).alias(f"{m}_delta") for m in ("mean", "median", "std")])


def categorical_drift(a: DataFrame, b: DataFrame, cats: Sequence[str]) -> DataFrame:
    """Total variation distance, largest share change, chi-square and category count.

    Nulls form their own category.
    """
    counts = _sides(a, b, cats, False).groupBy("feature", "value").agg(
        F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    sizes = attach_scalars(a.agg(F.count(F.lit(1)).alias("n_a")), b.agg(F.count(F.lit(1)).alias("n_b")))
    c = attach_scalars(counts, sizes)
    gap = F.abs(ratio(F.col("a"), F.col("n_a"), 0.0) - ratio(F.col("b"), F.col("n_b"), 0.0))
    row = F.col("a") + F.col("b")
    n = F.col("n_a") + F.col("n_b")
    ea, eb = row * F.col("n_a") / n, row * F.col("n_b") / n
    plain = (F.col("a") - ea) ** 2 / ea + (F.col("b") - eb) ** 2 / eb
    half = F.least(F.lit(0.5), F.abs(F.col("a") - ea))
    yates = (F.abs(F.col("a") - ea) - half) ** 2 * (F.lit(1.0) / ea + F.lit(1.0) / eb)
    agg = c.groupBy("feature").agg(
        (F.sum(gap) / 2).alias("total_variation_distance"),
        F.max(gap).alias("max_proportion_delta"),
        F.count(F.lit(1)).alias("categories"), F.sum(plain).alias("__plain"),
        F.sum(yates).alias("__yates"))
    chi2 = (F.when(F.col("categories") < 2, F.lit(0.0)).when(F.col("categories") == 2, F.col("__yates"))
            .otherwise(F.col("__plain")))
    return agg.withColumn("chi_square", chi2).select(
        "feature", "total_variation_distance", "max_proportion_delta", "chi_square",
        F.when(F.col("categories") < 2, F.lit(1.0)).otherwise(
            chi2_pvalue("chi_square", (F.col("categories") - 1).cast("double"))).alias("p_value"),
        "categories")


def smd_drift(a: DataFrame, b: DataFrame, nums: Sequence[str], ddof: int = 0) -> DataFrame:
    """(mean_b - mean_a) / sqrt((var_a + var_b) / 2); ``ddof`` picks the variance."""
    var = F.var_samp if ddof else F.var_pop
    left = per_column(a, nums, lambda c: {"mean_a": F.avg(number(c)), "var_a": var(number(c))})
    right = per_column(b, nums, lambda c: {"mean_b": F.avg(number(c)), "var_b": var(number(c))})
    pooled = F.sqrt((F.col("var_a") + F.col("var_b")) / 2)
    smd = F.coalesce(ratio(F.col("mean_b") - F.col("mean_a"), pooled), F.lit(0.0))
    return left.join(right, "feature").select(
        "feature", "mean_a", "mean_b", smd.alias("smd"), F.abs(smd).alias("abs_smd"))


def redundancy(df: DataFrame, nums: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of numbers from one scan, with a level."""
    pairs = [(a, b) for i, a in enumerate(nums) for b in nums[i + 1:]]
    structs = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                        correlation(number(a), number(b)).alias("correlation")) for a, b in pairs]
    r = F.col("abs_correlation")
    level = (F.when(r >= 0.9, "very_high").when(r >= 0.8, "high").when(r >= 0.7, "moderate")
             .otherwise("low"))
    return (df.agg(F.array(*structs).alias("r")).select(F.inline("r"))
            .filter(F.col("correlation").isNotNull())
            .withColumn("abs_correlation", F.abs("correlation")).withColumn("level", level))


def mutual_information(df: DataFrame, cats: Sequence[str], nums: Sequence[str], y: str,
                       bins: int = 10) -> DataFrame:
    """Plug-in mutual information with a 0/1 label in nats; numbers by quantile bin."""
    label = quoted(y).cast("string").alias("y")
    known = df.filter(quoted(y).isNotNull())
    parts = []
    if cats:
        parts.append(melt(known, cats, [label]).select(
            "feature", "y", F.coalesce("value", F.lit("null")).alias("value")))
    if nums:
        edges = quantile_edges(known, nums, bins).select("feature", "q")
        long = melt(known, nums, [label], as_number=True).filter(F.col("value").isNotNull())
        parts.append(long.join(F.broadcast(edges), "feature").select(  # one row per feature
            "feature", "y", bin_label(bins).cast("string").alias("value")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    cells = materialize(rows.groupBy("feature", "value", "y").agg(F.count(F.lit(1)).alias("o")))
    r = cells.groupBy("feature", "value").agg(F.sum("o").alias("r"))
    c = cells.groupBy("feature", "y").agg(F.sum("o").alias("c"))
    n = cells.groupBy("feature").agg(F.sum("o").alias("n"))
    o = F.col("o") / F.col("n")
    full = cells.join(r, ["feature", "value"]).join(small_side(c.join(n, "feature")), ["feature", "y"])
    return full.groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum(
        o * F.log(F.col("o") * F.col("n") / (F.col("r").cast("double") * F.col("c"))))
    ).alias("mutual_information"))


def effect_strength(df: DataFrame, cats: Sequence[str], y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Largest category deviation and the weighted spread of category rates around the overall rate."""
    rates = rate_by_category(df, cats, y, keys)
    dev = F.col("deviation_pp") / 100
    return rates.groupBy(*[quoted(k) for k in keys], "feature").agg(
        F.count(F.lit(1)).alias("categories"), F.max(F.abs(dev)).alias("max_rate_deviation"),
        F.sqrt(F.sum(F.col("total") * dev * dev) / F.sum("total")).alias("effect_strength"))


def target_drift(a: DataFrame, b: DataFrame, y: str) -> DataFrame:
    """Rows, positives and rate on each side, and the change in percentage points."""
    def side(df: DataFrame, s: str) -> DataFrame:
        return df.filter(quoted(y).isNotNull()).agg(
            F.count(F.lit(1)).alias(f"rows_{s}"), F.sum(quoted(y).cast("long")).alias(f"positives_{s}"),
            (F.avg(quoted(y)) * 100).alias(f"rate_{s}"))
    return attach_scalars(side(a, "a"), side(b, "b")).withColumn(
        "difference_pp", F.col("rate_b") - F.col("rate_a"))


def rank_features(df: DataFrame, nums: Sequence[str], cats: Sequence[str], y: str,
                  keys: Sequence[str] = ()) -> DataFrame:
    """One ranking per key: |r| for numbers, largest rate deviation for categories."""
    from pyspark.sql import Window
    num = point_biserial(df, nums, y, keys).select(
        *keys, "feature", F.lit("numeric").alias("kind"), F.coalesce("abs_r", F.lit(0.0)).alias("score"))
    cat = effect_strength(df, cats, y, keys).select(
        *keys, "feature", F.lit("categorical").alias("kind"), F.col("max_rate_deviation").alias("score"))
    w = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(F.desc("score"), "feature")
    return num.unionByName(cat).withColumn("rank", F.row_number().over(w))  # one row per feature


def correlation_stability(df: DataFrame, nums: Sequence[str], y: str, split: str) -> DataFrame:
    """Spread of r over training splits; ``df`` holds one row per (row, split) it trains on."""
    r = point_biserial(df, nums, y, [split])
    v = F.coalesce("r", F.lit(0.0))
    pos, neg = F.count_if(v > 0), F.count_if(v < 0)
    return r.groupBy("feature").agg(
        F.avg(v).alias("mean_r"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std_r"),
        F.min(v).alias("min_r"), F.max(v).alias("max_r"), pos.alias("positive_splits"),
        neg.alias("negative_splits"),
        (F.greatest(pos, neg) / F.count(F.lit(1))).alias("direction_consistency"))
