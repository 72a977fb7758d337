"""Permutation importance, feature selection and stability over splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted, ratio
from plumbline.operators import batched
from plumbline.operators.metrics import ranking_metrics
from plumbline.operators.models import (
    FEWEST_BOOSTED, ModelSpec, _batchable, _union, batched_ranking, fit, in_parallel, score,
)
from plumbline.operators.stats import rank_features
from plumbline.session import materialize

#: Buckets of the hash order that are sorted by themselves; no result depends on their number.
BUCKETS = 1 << 16


def permuted_variants(df: DataFrame, cols: Sequence[str], ids: Sequence[str], repeats: int = 5,
                      seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """One copy of the rows per (column, repeat) with that column permuted.

    Rows are put in a random order by key hash and take the value of the next row, the
    last one that of the first. Ranges of the hash are sorted apart; the last row of a range
    takes the first value of the next range that has rows, so it is one order over the whole
    table without a global sort.
    """
    variants = F.array(*[F.struct(F.lit(c).alias("permuted"), F.lit(r).alias("repeat"))
                         for c in cols for r in range(repeats)])
    key = F.xxhash64(F.lit(seed), F.col("repeat"), F.col("permuted"), *[quoted(i) for i in ids])
    long = df.select("*", F.inline(variants)).withColumn("__order", key).withColumn(
        "__bucket", F.floor(F.col("__order") / F.lit(2.0 ** 64) * F.lit(buckets)))
    group, values = ["permuted", "repeat", "__bucket"], F.struct(*[quoted(c) for c in cols])
    place = F.struct("__order", *[quoted(i) for i in ids])
    # One row per bucket; at most ``buckets`` of them meet in a window.
    ring = Window.partitionBy("permuted", "repeat").orderBy("__bucket")
    follow = long.groupBy(*group).agg(F.min_by(values, place).alias("__first")).select(
        *group, F.coalesce(F.lead("__first").over(ring), F.first("__first").over(ring)).alias("__follow"))
    after = F.lead(values).over(Window.partitionBy(*group).orderBy("__order", *[quoted(i) for i in ids]))
    placed = long.withColumn("__after", after).join(follow, group)
    taken = F.coalesce("__after", "__follow")
    swapped = {c: F.when(F.col("permuted") == c, taken[c]).otherwise(quoted(c)) for c in cols}
    return placed.withColumns(swapped).drop("__order", "__bucket", "__after", "__follow")


def permutation_importance(df: DataFrame, model, cols: Sequence[str], ids: Sequence[str], repeats: int = 5,
                           seed: int = 42, label: str = "y", buckets: int = BUCKETS) -> DataFrame:
    """AUC drop after permuting one source column: mean and std over repeats.

    All (column, repeat) variants are scored and evaluated in one job.
    """
    spark = df.sparkSession
    plain = df.withColumn("permuted", F.lit(None).cast("string")).withColumn("repeat", F.lit(0))
    variants = permuted_variants(df, cols, ids, repeats, seed, buckets)
    # Every variant has a number, 0 are the rows as they are.
    numbers = {(c, r): 1 + i * repeats + r for i, c in enumerate(cols) for r in range(repeats)}
    first = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(numbers[c, 0]))])
    keep = [F.when(F.col("permuted").isNull(), 0).otherwise(first[F.col("permuted")] + F.col("repeat")).cast("int").alias("n"),
            quoted(label).cast("int").alias("y"), "p"]
    # Scores are written once: filters pushed below them would run the model again.
    pred = materialize(score(plain, model).select(*keep).unionByName(score(variants, model).select(*keep)))
    rows = pred.filter("n = 0").count()
    auc = {n: m[0] for n, m in batched.rank_scores(pred, [rows] * (1 + len(numbers))).items()}
    found = spark.createDataFrame([(c, None if auc[n] is None else auc[0] - auc[n]) for (c, _), n in numbers.items() if n in auc],
                                  "feature string, __drop double")
    return found.groupBy("feature").agg(
        F.avg("__drop").alias("importance_mean"), F.stddev_pop("__drop").alias("importance_std"))


def select_features(importance: DataFrame, quantile: float = 0.75, at_least: int = 3,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Positive importances at or above their quantile, at least the best three.

    With no positive importance the best features are kept. One row per feature enters.
    """
    w = Window.partitionBy(*[quoted(k) for k in keys], F.lit(0))
    pos = F.col("importance_mean") > 0
    order = w.orderBy(F.desc("importance_mean"), "feature")
    rows = importance.select(
        *keys, "feature", "importance_mean", F.row_number().over(order).alias("rank"),
        F.count_if(pos).over(w).alias("__positive"),
        F.percentile(F.when(pos, F.col("importance_mean")), F.lit(quantile)).over(w).alias("__cut"))
    rows = rows.withColumn("__above", F.coalesce(pos & (F.col("importance_mean") >= F.col("__cut")), F.lit(False)))
    enough = F.count_if(F.col("__above")).over(w) >= F.least(F.lit(at_least), F.count(F.lit(1)).over(w))
    keep = (F.when(F.col("__positive") == 0, F.col("rank") <= at_least)
            .when(enough, F.col("__above")).otherwise(pos & (F.col("rank") <= at_least)))
    return rows.withColumn("__keep", keep).filter("__keep").select(*keys, "feature", "importance_mean", "rank")


def top_features(importance: DataFrame, k: int) -> DataFrame:
    """The k most important features."""
    w = Window.orderBy(F.desc("importance_mean"), "feature")
    return importance.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def stability_score(importance: DataFrame, selected: DataFrame, coefs: DataFrame, stable: float = 0.7,
                    moderate: float = 0.4) -> DataFrame:
    """Combined stability per feature over splits.

    ``importance(split, model, feature, importance_mean)``, ``selected(split, feature)``,
    ``coefs(split, feature, coefficient)``. Score = 0.5 selection frequency + 0.3 share of
    positive importances + 0.2 mean importance relative to the largest.
    """
    splits = importance.agg(F.count_distinct("split").alias("__splits"))
    v = F.col("importance_mean")
    imp = importance.groupBy("feature").agg(
        F.avg(v).alias("mean_importance"), F.stddev_samp(v).alias("std_importance"),
        F.avg((v > 0).cast("double")).alias("positive_importance_frequency"))
    sel = selected.select("split", "feature").distinct().groupBy("feature").agg(
        F.count(F.lit(1)).alias("__times"))
    c = F.col("coefficient")
    coef = coefs.groupBy("feature").agg(
        F.avg(c).alias("coefficient_mean"), F.stddev_samp(c).alias("coefficient_std"),
        F.greatest(F.avg((c > 0).cast("double")), F.avg((c < 0).cast("double"))).alias("direction_consistency"))
    direction = (F.when(F.col("coefficient_mean") > 0, "positive").when(F.col("coefficient_mean") < 0, "negative")
                 .when(F.col("coefficient_mean") == 0, "neutral").otherwise("unavailable"))
    largest = imp.agg(F.max(F.abs("mean_importance")).alias("m"))
    out = imp.join(sel, "feature", "left").join(coef, "feature", "left").withColumn(
        "selection_frequency", F.coalesce("__times", F.lit(0)) / splits.scalar()).withColumn(
        "normalized_importance", ratio(F.greatest("mean_importance", F.lit(0.0)), largest.scalar(), 0.0))
    total = (0.5 * F.col("selection_frequency") + 0.3 * F.col("positive_importance_frequency")
             + 0.2 * F.col("normalized_importance"))
    return out.drop("__times").withColumns({
        "dominant_direction": direction, "stability_score": total,
        "stability_class": F.when(F.col("selection_frequency") >= stable, "stable")
        .when(F.col("selection_frequency") >= moderate, "moderately_stable").otherwise("weak")})


def coefficient_stability(coefs: DataFrame) -> DataFrame:
    """Spread and sign counts per feature over splits of
    ``(split, feature, coefficient_mean, coefficient_abs_mean)``."""
    m, a = F.col("coefficient_mean"), F.col("coefficient_abs_mean")
    pos, neg, zero = F.count_if(m > 0), F.count_if(m < 0), F.count_if(F.abs(m) <= 1e-8)
    n = F.count(F.lit(1))
    consistency = F.greatest(pos, neg, zero) / n
    return coefs.groupBy("feature").agg(
        F.avg(m).alias("mean_coefficient"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias("std_coefficient"),
        F.avg(a).alias("mean_absolute_coefficient"),
        F.coalesce(F.stddev_samp(a), F.lit(0.0)).alias("std_absolute_coefficient"),
        pos.alias("positive_splits"), neg.alias("negative_splits"), zero.alias("zero_splits"),
        consistency.alias("direction_consistency"), n.alias("split_count"),
        F.when(consistency >= 0.9, "stable").when(consistency < 0.7, "unstable").otherwise("mixed").alias("stability"))


def selection_frequency(results: DataFrame, keys: Sequence[str] = ("subset_size",),
                        features: str = "features") -> DataFrame:
    """How often each feature of a '|'-joined list occurs per key."""
    runs = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("__runs"))
    lists = results.select(*keys, F.explode(F.split(quoted(features), "\\|")).alias("feature"))
    return lists.groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("times")).join(runs, list(keys)).select(
        *keys, "feature", "times", ratio(F.col("times"), F.col("__runs")).alias("selection_frequency"))


def subset_evaluation(df: DataFrame, specs: Sequence[ModelSpec], sizes: Sequence[int], ids: Sequence[str],
                      label: str = "y", ranking: Callable[[DataFrame], DataFrame] | None = None,
                      parallelism: int = 4) -> DataFrame:
    """AUC and AP per (split, model, subset size) of the top-k features.

    ``df`` holds one row per (row, repeat) with ``repeat``, ``fold`` and ``split``. Features are
    ranked on the training rows of each split, so the held-out fold stays unseen. The
    rankings of all splits come from one job over the training copies of each row.
    """
    base = df.persist()
    spec0 = specs[0]
    splits = base.select("repeat", "fold", "split").distinct().orderBy("split").collect()
    per_repeat = base.select("repeat", "split").distinct().withColumnRenamed("split", "train_split")
    training = base.join(F.broadcast(per_repeat), "repeat").filter(F.col("split") != F.col("train_split"))
    rank = ranking or (lambda t: rank_features(t, spec0.nums, spec0.cats, label, ["train_split"]))
    ranked: dict[int, list[str]] = {}
    for r in rank(training).orderBy("train_split", "rank").collect():  # splits x features rows
        ranked.setdefault(r["train_split"], []).append(r["feature"])

    names = {f"{s.name}\t{k}": (s, k) for s in specs for k in sizes}
    variants = [replace(s, name=name) for name, (s, k) in names.items()]
    where = {(r["repeat"], r["fold"]): ranked[r["split"]] for r in splits}

    def chosen(spec: ModelSpec, repeat: int, fold: int) -> list[str]:
        return where[repeat, fold][:names[spec.name][1]]

    try:
        found = batched_ranking(base, variants, ids, label, chosen=chosen) if all(
            s in _batchable(specs, FEWEST_BOOSTED) for s in specs) else None
        folds = len({r["fold"] for r in splits})  # the batched fits number the splits by themselves
        number = {r["split"]: r["split"] if found is None else r["repeat"] * folds + r["fold"] for r in splits}
        if found is None:
            found = [ranking_metrics(_subsets_one_by_one(base, variants, splits, chosen, label, parallelism), ["model", "split"])]
        shown = F.create_map(*[x for split, n in number.items() for k in sizes
                               for x in (F.lit(f"{n}\t{k}"), F.lit("|".join(ranked[split][:k])))])
        parts = F.split("model", "\t")
        return materialize(found[0].select(
            parts[0].alias("model"), parts[1].cast("int").alias("subset_size"), "split",
            shown[F.concat_ws("\t", "split", parts[1])].alias("features"), "roc_auc", "pr_auc"))
    finally:
        base.unpersist()


def _subsets_one_by_one(base: DataFrame, variants: Sequence[ModelSpec], splits: Sequence, chosen: Callable, label: str,
                        parallelism: int) -> DataFrame:
    def job(spec: ModelSpec, row) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            part = base.filter(F.col("repeat") == row["repeat"])
            own = spec.with_features(chosen(spec, row["repeat"], row["fold"]))
            model = fit(own, part.filter(F.col("fold") != row["fold"]), label=label, cache=False)
            held = score(part.filter(F.col("fold") == row["fold"]), model)
            return materialize(held.select(quoted(label).cast("int").alias("y"), "p", F.lit(spec.name).alias("model"),
                                           "repeat", "fold", "split"))
        return run

    return _union(in_parallel([job(s, r) for s in variants for r in splits], parallelism))
