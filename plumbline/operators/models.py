"""Training, out-of-fold prediction, selection and scoring with Spark ML.

A prediction table ``(id…, y, p, model, split…)`` is the central result: every
metric of every model and split is then one grouped job over it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import product

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import attach_scalars, quoted, ratio, require_columns
from plumbline.operators import batched, forest
from plumbline.operators.features import encoded_names, fit_preprocessor
from plumbline.operators.metrics import ranking_metrics, threshold_metrics, with_rates
from plumbline.session import materialize


#: The deepest tree that Spark grows.
DEEPEST = 30
#: Memory for the statistics of the nodes that one job of a forest splits.
FOREST_MB = 1024
#: Parameters that the batched fits know, and how many boosted fits make a batch worth its jobs.
LOGISTIC_PARAMS, GBT_PARAMS = {"C", "maxIter"}, {"maxIter", "stepSize", "maxDepth", "minInstancesPerNode", "subsamplingRate"}
FEWEST_BOOSTED = 4
FOREST_PARAMS = {"numTrees", "maxDepth", "minInstancesPerNode", "featureSubsetStrategy"}
#: Rows up to which Spark fits single trees on the rows themselves; more are counted by cells of bins first.
ROWS_FOR_TREES = 100_000
#: Candidates whose fits and predictions are held at the same time.
CANDIDATES_AT_ONCE = 8


@dataclass(frozen=True)
class ModelSpec:
    """A classifier family with its parameters and feature roles."""

    name: str
    family: str  # "logistic", "forest" or "gbt"
    nums: tuple[str, ...]
    cats: tuple[str, ...] = ()
    params: dict = field(default_factory=dict, hash=False)
    balanced: bool = False
    scaled: bool = True

    def with_features(self, features: Iterable[str]) -> ModelSpec:
        keep = set(features)
        return replace(self, nums=tuple(c for c in self.nums if c in keep),
                       cats=tuple(c for c in self.cats if c in keep))

    @property
    def features(self) -> list[str]:
        return [*self.nums, *self.cats]


def logistic(name: str, nums: Sequence[str], cats: Sequence[str] = (), C: float = 1.0,
             balanced: bool = True, **params) -> ModelSpec:
    """L2 logistic regression; the penalty is 1 / (C * rows) on the mean loss."""
    return ModelSpec(name, "logistic", tuple(nums), tuple(cats), {"C": C, **params}, balanced)


def random_forest(name: str, nums: Sequence[str], cats: Sequence[str] = (), trees: int = 400,
                  depth: int = DEEPEST, min_leaf: int = 10, balanced: bool = True, **params) -> ModelSpec:
    """Random forest with sqrt feature sampling."""
    return ModelSpec(name, "forest", tuple(nums), tuple(cats),
                     {"numTrees": trees, "maxDepth": depth, "minInstancesPerNode": min_leaf, **params},
                     balanced, scaled=False)


def gbt(name: str, nums: Sequence[str], cats: Sequence[str] = (), iterations: int = 100,
        rate: float = 0.05, depth: int = 3, min_leaf: int = 10, subsample: float = 1.0, **params) -> ModelSpec:
    """Histogram gradient boosting."""
    return ModelSpec(name, "gbt", tuple(nums), tuple(cats),
                     {"maxIter": iterations, "stepSize": rate, "maxDepth": depth,
                      "minInstancesPerNode": min_leaf, "subsamplingRate": subsample, **params}, False)


def _estimator(spec: ModelSpec, rows: int, seed: int):
    common = {"featuresCol": "features", "labelCol": "y"}
    if spec.balanced:
        common["weightCol"] = "__weight"
    params = dict(spec.params)
    if spec.family == "logistic":
        reg = 1.0 / (params.pop("C", 1.0) * max(rows, 1))
        return LogisticRegression(regParam=reg, elasticNetParam=0.0, standardization=False,
                                  **{"maxIter": 200, **params}, **common)
    if spec.family == "forest":
        # Deep trees have many nodes per level: more of them fit one job, and rows keep their node.
        return RandomForestClassifier(seed=seed, **{"featureSubsetStrategy": "sqrt", "maxMemoryInMB": FOREST_MB, "cacheNodeIds": True,
                                                    **params}, **common)
    if spec.family == "gbt":
        return GBTClassifier(seed=seed, **params, **common)
    raise ValueError(f"unknown family {spec.family}")


def fit(spec: ModelSpec, train: DataFrame, seed: int = 42, label: str = "y",
        cache: bool = True) -> PipelineModel:
    """Fit preparation and classifier on labelled training rows.

    Fitting reads the rows several times; ``cache`` keeps the needed columns meanwhile.
    Switch it off where ``train`` is a filter over cached rows.
    """
    require_columns(train, spec.features)
    rows = train.filter(quoted(label).isNotNull()).select(
        *[quoted(c) for c in spec.features], quoted(label).cast("double").alias("y"))
    if cache:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit(spec, rows, seed)
    finally:
        if cache:
            rows.unpersist()


def _fit(spec: ModelSpec, rows: DataFrame, seed: int) -> PipelineModel:
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).first()
    if spec.balanced:
        n, p = sizes["n"], sizes["p"]
        weight = F.when(F.col("y") == 1, F.lit(n / (2 * p) if p else 1.0)).otherwise(
            F.lit(n / (2 * (n - p)) if n > p else 1.0))
        rows = rows.withColumn("__weight", weight)
    by_cells = {"forest": FOREST_PARAMS, "gbt": GBT_PARAMS}.get(spec.family)
    if by_cells and set(spec.params) <= by_cells and spec.params.get("subsamplingRate", 1.0) == 1.0 and sizes["n"] > ROWS_FOR_TREES:
        # Few files are read by few tasks; the rows of the features are narrow, and several passes follow.
        spread = rows.select(*[quoted(c) for c in spec.features], "y").repartition(rows.sparkSession.sparkContext.defaultParallelism).persist(
            StorageLevel.MEMORY_AND_DISK)
        try:
            found = forest.fit_on_cells(fit_preprocessor(spread, spec.nums, spec.cats, spec.scaled), spread, spec.nums, spec.cats,
                                        spec.family, spec.params, spec.balanced, sizes["n"], seed)
        finally:
            spread.unpersist()
        if found is not None:
            return found
    prep = fit_preprocessor(rows, spec.nums, spec.cats, spec.scaled)
    model = _estimator(spec, sizes["n"], seed).fit(prep.transform(rows))
    return PipelineModel(stages=[*prep.stages, model])


def score(df: DataFrame, model, threshold: float = 0.5, features: Sequence[str] | None = None) -> DataFrame:
    """Append ``p``, ``threshold`` and ``flag``; works on batches and streams.

    A missing feature fails, unseen categories are scored, other columns pass through.
    Write or checkpoint the result before measuring it: each metric reads it again.
    """
    if features is not None:
        require_columns(df, features)
    keep = [quoted(c) for c in df.columns]
    out = model.transform(df).select(*keep, vector_to_array("probability")[1].alias("p"))
    return out.withColumn("threshold", F.lit(float(threshold))).withColumn(
        "flag", (F.col("p") >= F.lit(float(threshold))).cast("int"))


def in_parallel(jobs: Sequence[Callable], parallelism: int = 4) -> list:
    """Run independent fits from a few driver threads so small jobs overlap."""
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(j)) for j in jobs]]


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def oof_pooled(df: DataFrame, specs: Sequence[ModelSpec], ids: Sequence[str], label: str = "y",
               parallelism: int = 4, seed: int = 42,
               fitter: Callable[[ModelSpec, DataFrame, int], object] | None = None) -> DataFrame:
    """Out-of-fold predictions, one row per (id, repeat, model).

    ``df`` holds one row per (row, repeat) with ``repeat``, ``fold`` and ``split``. The
    prediction table is checkpointed: everything downstream reads it many times. Logistic and
    boosted models of all splits are fitted together, see ``batched``; the others one by one.
    """
    together = [] if fitter else _batchable(specs, df)
    done = batched_predictions(df, together, ids, label, seed) if together else None
    rest = [s for s in specs if done is None or s not in together]
    if not rest:
        return done
    single = _fitted_one_by_one(df, rest, ids, label, parallelism, seed, fitter)
    return single if done is None else done.unionByName(single)


def _batchable(specs: Sequence[ModelSpec], splits: int | DataFrame) -> list[ModelSpec]:
    """The specs that are fitted together; the splits of a table are only counted where that decides."""
    boosted = [s for s in specs if s.family == "gbt" and set(s.params) <= GBT_PARAMS]
    if 0 < len(boosted) < FEWEST_BOOSTED:
        n = splits if isinstance(splits, int) else splits.select("repeat", "fold").distinct().count()
        boosted = boosted if len(boosted) * n >= FEWEST_BOOSTED else []
    return [s for s in specs if s.family == "logistic" and set(s.params) <= LOGISTIC_PARAMS] + boosted


def batched_predictions(df: DataFrame, specs: Sequence[ModelSpec], ids: Sequence[str], label: str = "y", seed: int = 42,
                        held: bool = True, chosen: Callable[[ModelSpec, int, int], Sequence[str]] | None = None) -> DataFrame | None:
    """Predictions of logistic and boosted specs on the held-out (or training) rows of all splits.

    ``chosen`` names the features of a spec in a split, all of its own by default. None if the columns
    have too many levels for dense models.
    """
    found = _batched_jobs(df, specs, ids, label, chosen)
    if found is None:
        return None
    e, jobs, boosted, copies = found
    parts = []
    if jobs:
        batched.fit_logistic(e, jobs)
        parts.append(materialize(batched.predict_logistic(e, jobs, held)))
    if boosted:
        pred = batched.fit_boosted(e, boosted, seed, held)
        parts.append(_with_copies(pred, copies))
    return _union(parts)


def batched_ranking(df: DataFrame, specs: Sequence[ModelSpec], ids: Sequence[str], label: str = "y", seed: int = 42,
                    sides: Sequence[bool] = (True,), chosen: Callable[[ModelSpec, int, int], Sequence[str]] | None = None,
                    encoded: batched.Encoded | None = None) -> list[DataFrame] | None:
    """(model, split, roc_auc, pr_auc) of ``batched_predictions``, on the held-out (True) or training rows per entry of ``sides``.

    Logistic models are fitted once for all sides, and none of their predictions is written. ``encoded`` has the rows if they
    are known already.
    """
    found = _batched_jobs(df, specs, ids, label, chosen, encoded)
    if found is None:
        return None
    e, jobs, boosted, copies = found
    if jobs:
        batched.fit_logistic(e, jobs)
    out = []
    for held in sides:
        parts = [batched.rank_logistic(e, jobs, held)] if jobs else []
        if boosted:
            parts.append(ranking_metrics(_with_copies(batched.fit_boosted(e, boosted, seed, held), copies), ["model", "split"]))
        out.append(_union(parts))
    return out


def _batched_jobs(df: DataFrame, specs: Sequence[ModelSpec], ids: Sequence[str], label: str,
                  chosen: Callable[[ModelSpec, int, int], Sequence[str]] | None, encoded: batched.Encoded | None = None) -> tuple | None:
    """The encoded rows, the logistic and the boosted jobs of all splits and the copies of the latter; None if there are too many levels."""
    e = encoded or batched.encode(df, *_features(specs), ids, label)
    if e is None:
        return None

    def features(spec: ModelSpec, split: batched.Split) -> tuple[tuple[str, ...], tuple[str, ...]]:
        own = spec if chosen is None else spec.with_features(chosen(spec, split.repeat, split.fold))
        return own.nums, own.cats

    jobs = [batched.LogisticJob(s.name, split, *features(s, split), s.params.get("C", 1.0), s.balanced, s.scaled)
            for s in specs if s.family == "logistic" for split in e.splits.values()]
    return e, jobs, *_boost_jobs(e, specs, features, chosen is not None)


def _boost_jobs(e: batched.Encoded, specs: Sequence[ModelSpec], features: Callable, apart: bool) -> tuple[list, dict[str, list[str]]]:
    """Boosted candidates that differ only in the number of iterations are stages of one fit; specs that are
    equal but for their names share a stage, the second result names them."""
    groups: dict[tuple, dict[int, list[ModelSpec]]] = {}
    for s in specs:
        if s.family == "gbt":
            p = {"maxIter": 20, "stepSize": 0.1, "maxDepth": 5, "minInstancesPerNode": 1, "subsamplingRate": 1.0, **s.params}
            same = (s.nums, s.cats, p["stepSize"], p["maxDepth"], p["minInstancesPerNode"], p["subsamplingRate"])
            same += (s.name,) if apart else ()
            groups.setdefault(same, {}).setdefault(p["maxIter"], []).append(s)
    jobs = [batched.BoostJob({t: found[0].name for t, found in stages.items()}, split, *features(next(iter(stages.values()))[0], split), *same[2:6])
            for same, stages in groups.items() for split in e.splits.values()]
    return jobs, {found[0].name: [s.name for s in found[1:]] for stages in groups.values() for found in stages.values() if found[1:]}


def _with_copies(df: DataFrame, copies: dict[str, list[str]]) -> DataFrame:
    """The rows of a model again under the names of those that are equal to it."""
    return _union([df, *[df.filter(F.col("model") == first).withColumn("model", F.lit(name)) for first, names in copies.items() for name in names]])


def _fitted_one_by_one(df: DataFrame, specs: Sequence[ModelSpec], ids: Sequence[str], label: str, parallelism: int, seed: int,
                       fitter: Callable[[ModelSpec, DataFrame, int], object] | None) -> DataFrame:
    """Each fit's predictions are written when it ends, so no plan holds more than one model."""
    fitter = fitter or (lambda s, d, k: fit(s, d, k, label, cache=False))
    base = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        folds = base.select("repeat", "fold", "split").distinct().orderBy("split").collect()

        def job(spec: ModelSpec, r: int, f: int) -> Callable[[], DataFrame]:
            def run() -> DataFrame:
                part = base.filter(F.col("repeat") == r)
                model = fitter(spec, part.filter(F.col("fold") != f), seed)
                held = score(part.filter(F.col("fold") == f), model)
                return materialize(held.select(*[quoted(c) for c in ids], quoted(label).cast("int").alias("y"), "p",
                                               F.lit(spec.name).alias("model"), "repeat", "fold", "split"))
            return run

        return _union(in_parallel([job(s, r["repeat"], r["fold"]) for s in specs for r in folds], parallelism))
    finally:
        base.unpersist()


def cross_validate(df: DataFrame, specs: Sequence[ModelSpec], ids: Sequence[str], label: str = "y",
                   threshold: float = 0.5, parallelism: int = 4) -> DataFrame:
    """Ranking and threshold metrics per (model, split)."""
    pred = oof_pooled(df, specs, ids, label, parallelism)
    keys = ["model", "split"]
    return ranking_metrics(pred, keys).join(threshold_metrics(pred, threshold, keys), keys)


def split_ranking(df: DataFrame, specs: Sequence[ModelSpec], ids: Sequence[str], label: str = "y", parallelism: int = 4,
                  seed: int = 42) -> DataFrame:
    """(model, split, roc_auc, pr_auc) on the held-out rows of all splits.

    Trees on bins give all rows of a cell one score, so theirs are ranked by the counts of the cells and no row is
    predicted; the scores of logistic models are ranked in ranges; the predictions of the other models are ranked row by row.
    """
    together = _batchable(specs, df)
    trees = [s for s in together if s.family == "gbt"] + [s for s in specs if s.family == "forest" and set(s.params) <= FOREST_PARAMS]
    plain = [s for s in together if s.family == "logistic"]
    # Rows are encoded once for models of the same features.
    encoded = batched.encode(df, *_features(trees), ids, label) if trees else None
    parts = _ranked_by_cells(df, encoded, trees, ids, label, seed) if encoded is not None else None
    done = list(trees) if parts is not None else []
    ranks = batched_ranking(df, plain, ids, label, seed, encoded=encoded if _features(trees) == _features(plain) else None) if plain else None
    if ranks is not None:
        parts, done = [*(parts or []), *ranks], done + plain
    rest = [s for s in specs if s not in done]
    if rest:
        parts = [*(parts or []), ranking_metrics(oof_pooled(df, rest, ids, label, parallelism, seed), ["model", "split"])]
    return _union(parts)


def _features(specs: Sequence[ModelSpec]) -> tuple[list[str], list[str]]:
    """All numbers and categories of the specs."""
    nums, cats = (list(dict.fromkeys(c for s in specs for c in getattr(s, kind))) for kind in ("nums", "cats"))
    return nums, cats


def _ranked_by_cells(df: DataFrame, e: batched.Encoded, specs: Sequence[ModelSpec], ids: Sequence[str], label: str, seed: int) -> list[DataFrame] | None:
    """None if the columns have too many levels or cells."""
    boosted, copies = _boost_jobs(e, specs, lambda s, split: (s.nums, s.cats), False)
    parts = [batched.rank_boosted(e, boosted, seed)] if boosted else []
    if boosted and parts[0] is None:
        return None
    # Forests that differ only in the number of trees and their depth are stages of one fit.
    groups: dict[tuple, dict[tuple[int, int], list[ModelSpec]]] = {}
    for s in specs:
        if s.family == "forest":
            p = {"numTrees": 20, "maxDepth": 5, "minInstancesPerNode": 1, "featureSubsetStrategy": "sqrt", **s.params}
            same = (s.nums, s.cats, p["minInstancesPerNode"], p["featureSubsetStrategy"], s.balanced)
            groups.setdefault(same, {}).setdefault((p["numTrees"], p["maxDepth"]), []).append(s)
    for features in {same[:2] for same in groups}:
        own = e if features == (tuple(e.nums), tuple(e.cats)) else batched.encode(df, *features, ids, label)
        wanted = [({at: found[0].name for at, found in stages.items()}, *same[2:]) for same, stages in groups.items() if same[:2] == features]
        parts.append(forest.rank_forests(own, wanted, seed))
        if parts[-1] is None:
            return None
    copies |= {found[0].name: [s.name for s in found[1:]] for stages in groups.values() for found in stages.values() if found[1:]}
    return [_with_copies(_union(parts), copies)]


def compare_families(df: DataFrame, specs: Sequence[ModelSpec], ids: Sequence[str], label: str = "y",
                     parallelism: int = 4) -> DataFrame:
    """Mean and spread of AUC and AP of several families over one shared fold table."""
    return _spread(split_ranking(df, specs, ids, label, parallelism))


def _spread(ranking: DataFrame) -> DataFrame:
    """Mean and spread over the splits of a model."""
    return ranking.groupBy("model").agg(
        F.count(F.lit(1)).alias("splits"), F.avg("roc_auc").alias("roc_auc_mean"),
        F.stddev_pop("roc_auc").alias("roc_auc_std"), F.avg("pr_auc").alias("pr_auc_mean"),
        F.stddev_pop("pr_auc").alias("pr_auc_std"))


def oof_mean(pred: DataFrame, ids: Sequence[str], keys: Sequence[str] = (), label: str = "y",
             score: str = "p") -> DataFrame:
    """Mean probability per row over its repeats."""
    return pred.groupBy(*[quoted(k) for k in keys], *[quoted(c) for c in ids]).agg(
        F.max(quoted(label)).alias("y"), F.avg(quoted(score)).alias("p"),
        F.count(quoted(score)).alias("predictions"))


def rows_without_prediction(df: DataFrame, pred: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows of the data no fold predicted; must be empty for a full out-of-fold table."""
    return df.select(*[quoted(c) for c in ids]).join(pred, list(ids), "left_anti")


def grid(spec: ModelSpec, options: dict[str, Sequence]) -> list[ModelSpec]:
    """Every combination of parameter values as a named candidate; ``balanced`` varies the class weights."""
    names = list(options)
    out = []
    for values in product(*[options[n] for n in names]):
        chosen = dict(zip(names, values))
        name = f"{spec.name} {json.dumps(chosen, sort_keys=True)}"
        out.append(replace(spec, name=name, balanced=chosen.pop("balanced", spec.balanced),
                           params={**spec.params, **chosen}))
    return out


def evaluate_candidates(df: DataFrame, candidates: Sequence[ModelSpec], ids: Sequence[str],
                        label: str = "y", parallelism: int = 4, train_scores: bool = False) -> DataFrame:
    """Cross-validated mean AUC and AP per candidate with its parameters and class weights as JSON.

    ``train_scores`` adds the means over the training rows of the splits; only batched fits have them.
    """
    together = _batchable(candidates, df)
    rest = [c for c in candidates if c not in together]
    groups = ([together] if together else []) + [rest[i:i + CANDIDATES_AT_ONCE] for i in range(0, len(rest), CANDIDATES_AT_ONCE)]
    # Logistic models are ranked on both sides by one fit.
    logistic_only = train_scores and together and all(c.family == "logistic" for c in together)
    sides = batched_ranking(df, together, ids, label, sides=(True, False)) if logistic_only else None
    scores = _union([materialize(_spread(sides[0]) if sides and g is together else compare_families(df, g, ids, label, parallelism))
                     for g in groups])
    if train_scores:
        found = sides[1:] if sides else batched_ranking(df, together, ids, label, sides=(False,)) if together else None
        if found is None:
            raise ValueError("training scores need logistic or boosted candidates with few levels")
        fitted = found[0].groupBy("model").agg(
            F.avg("roc_auc").alias("train_roc_auc_mean"), F.avg("pr_auc").alias("train_pr_auc_mean"))
        scores = scores.join(materialize(fitted), "model", "left")
    info = df.sparkSession.createDataFrame(
        [(c.name, c.family, json.dumps({**c.params, **({} if c.family == "gbt" else {"balanced": c.balanced})}, sort_keys=True))
         for c in candidates], "model string, family string, parameters string")
    return scores.join(F.broadcast(info), "model")


def grid_search(df: DataFrame, spec: ModelSpec, options: dict[str, Sequence], ids: Sequence[str],
                label: str = "y", parallelism: int = 4, train_scores: bool = False) -> tuple[DataFrame, ModelSpec]:
    """All combinations ranked by mean AUC, and the best specification."""
    candidates = grid(spec, options)
    ranked = rank_models(evaluate_candidates(df, candidates, ids, label, parallelism, train_scores))
    best = ranked.filter(F.col("rank") == 1).first()["model"]
    return ranked, next(c for c in candidates if c.name == best)


def search_and_refit(df: DataFrame, spec: ModelSpec, options: dict[str, Sequence], ids: Sequence[str], label: str = "y",
                     parallelism: int = 4) -> tuple[DataFrame, ModelSpec, PipelineModel]:
    """``grid_search`` with training scores, and its best specification fitted on every row once."""
    ranked, best = grid_search(df, spec, options, ids, label, parallelism, train_scores=True)
    first = df.agg(F.min("repeat").alias("r"))
    return ranked, best, fit(best, df.filter(F.col("repeat") == first.scalar()), label=label)


def rank_models(results: DataFrame, first: str = "roc_auc_mean", second: str = "pr_auc_mean") -> DataFrame:
    """1-based rank by two descending metrics, then name (one row per model)."""
    w = Window.orderBy(F.desc(first), F.desc(second), "model")
    return results.withColumn("rank", F.row_number().over(w))


def compare_with_baseline(ranked: DataFrame, baseline: dict[str, float]) -> DataFrame:
    """Best model against stored baseline metrics."""
    best = ranked.filter(F.col("rank") == 1)
    return best.select("model", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(float(b)).alias("baseline"), F.col(m).alias("value"),
                 (F.col(m) - F.lit(float(b))).alias("change")) for m, b in baseline.items()])))


def majority_baseline(train: DataFrame, test: DataFrame, label: str = "y") -> DataFrame:
    """Predict the training majority for every test row and measure it."""
    mode = train.filter(quoted(label).isNotNull()).agg(
        F.when(F.avg(quoted(label)) > 0.5, 1).otherwise(0).alias("majority"))
    pred = attach_scalars(test.filter(quoted(label).isNotNull()).select(quoted(label).cast("int").alias("y")), mode)
    y, m = F.col("y"), F.col("majority")
    counts = pred.agg(F.max("majority").alias("majority"),
                      F.count_if((m == 0) & (y == 0)).alias("tn"), F.count_if((m == 1) & (y == 0)).alias("fp"),
                      F.count_if((m == 0) & (y == 1)).alias("fn"), F.count_if((m == 1) & (y == 1)).alias("tp"))
    return with_rates(counts)


def holdout_evaluate(train: DataFrame, test: DataFrame, specs: Sequence[ModelSpec], label: str = "y",
                     threshold: float = 0.5, parallelism: int = 4) -> DataFrame:
    """Fit on train, score test: all metrics per model."""
    def job(spec: ModelSpec) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            return score(test, fit(spec, train, label=label)).select(
                quoted(label).cast("int").alias("y"), "p", F.lit(spec.name).alias("model"))
        return run
    pred = materialize(_union(in_parallel([job(s) for s in specs], parallelism)))
    return ranking_metrics(pred, ["model"]).join(threshold_metrics(pred, threshold, ["model"]), "model")


def coefficients(model: PipelineModel) -> DataFrame:
    """Coefficient per encoded column with its source column."""
    from pyspark.sql import SparkSession
    values = model.stages[-1].coefficients.toArray()
    rows = [(n, s, float(v)) for (n, s), v in zip(encoded_names(model), values)]
    return SparkSession.active().createDataFrame(rows, "encoded string, feature string, coefficient double")


def aggregate_coefficients(coefs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Coefficients folded back to source columns."""
    c = F.col("coefficient")
    return coefs.groupBy(*keys, "feature").agg(
        F.avg(c).alias("coefficient_mean"), F.avg(F.abs(c)).alias("coefficient_abs_mean"),
        F.max(F.abs(c)).alias("coefficient_abs_max"), F.count(c).alias("encoded_columns"))


def feature_importance(model: PipelineModel) -> DataFrame:
    """|coefficient| or impurity importance per source column, largest first."""
    from pyspark.sql import SparkSession
    last = model.stages[-1]
    values = (last.featureImportances if hasattr(last, "featureImportances") else last.coefficients).toArray()
    totals: dict[str, float] = {}
    for (_, src), v in zip(encoded_names(model), values):
        totals[src] = totals.get(src, 0.0) + abs(float(v))
    rows = [(type(last).__name__, f, v) for f, v in totals.items()]
    return SparkSession.active().createDataFrame(
        rows, "model_type string, feature string, importance double").orderBy(F.desc("importance"), "feature")


def model_information(model: PipelineModel) -> DataFrame:
    """Model type, number of encoded features and parameters as JSON."""
    from pyspark.sql import SparkSession
    last = model.stages[-1]
    params = {p.name: v for p, v in last.extractParamMap().items() if isinstance(v, (int, float, str, bool))}
    return SparkSession.active().createDataFrame(
        [(type(last).__name__, int(last.numFeatures), json.dumps(params, sort_keys=True))],
        "model_type string, encoded_features int, parameters string")


def training_checks(df: DataFrame, spec: ModelSpec, ids: Sequence[str], label: str = "y", folds: int = 5,
                    expected: dict | None = None) -> DataFrame:
    """(check, passed): what a table must fulfil before a production model is fitted on it.

    ``expected`` adds ``canonical_checks`` against a known version of the table.
    """
    there = [c for c in spec.features if c in df.columns]
    y = quoted(label).try_cast("double")
    facts = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(y.isNull()).alias("unlabelled"), F.count_if(y == 1).alias("pos"),
                   F.count_if(y == 0).alias("neg"), *[F.count(quoted(c)).alias(f"known_{i}") for i, c in enumerate(there)])
    keys = df.groupBy(*[quoted(c) for c in ids]).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count_if(reduce(lambda a, c: a | c, [quoted(c).isNull() for c in ids])).alias("gaps"))
    values = F.lit(True)
    for i in range(len(there)):
        values = values & (F.col(f"known_{i}") > 0)
    checks = {"has_rows": F.col("rows") > 0, "features_present": F.lit(len(there) == len(spec.features)), "features_have_values": values,
              "target_complete": F.col("unlabelled") == 0,
              "target_is_binary": F.col("pos") + F.col("neg") == F.col("rows") - F.col("unlabelled"),
              "each_class_fills_the_folds": F.least("pos", "neg") >= folds,
              "identifier_unique": F.col("most") <= 1, "identifier_complete": F.col("gaps") == 0}
    own = attach_scalars(facts, keys).select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in checks.items()])))
    if expected is None:
        return own
    from plumbline.operators.contract import canonical_checks
    return own.unionByName(canonical_checks(df, expected).withColumn("check", F.concat(F.lit("expected: "), "check")))


def fit_production(df: DataFrame, spec: ModelSpec, path: str, threshold: float = 0.25, folds: int = 5,
                   ids: Sequence[str] = (), label: str = "y", metadata: dict | None = None,
                   expected: dict | None = None) -> DataFrame:
    """Fit the calibrated model on all rows, save it under ``path`` and return its metadata row.

    The table is validated first (``training_checks``); nothing is fitted or written if a check fails.
    """
    from plumbline.operators.calibrate import calibrated_cv
    from plumbline.sources.fingerprint import content_fingerprint
    from plumbline.sources.writers import write_report_json
    checks = [tuple(r) for r in training_checks(df, spec, ids, label, folds, expected).collect()]
    failed = [name for name, passed in checks if not passed]
    if failed:
        raise ValueError(f"the table fails {failed}")
    model = calibrated_cv(df, spec, ids, folds, label=label)
    model.save(path)
    facts = df.agg(F.count(F.lit(1)).alias("training_rows"), F.avg(quoted(label)).alias("prevalence"))
    facts = attach_scalars(facts, content_fingerprint(df).select("content_hash"))
    meta = facts.select(
        F.lit(spec.name).alias("model"), F.lit(spec.family).alias("family"),
        F.array(*[F.lit(c) for c in spec.features]).alias("features"),
        F.lit(json.dumps(spec.params, sort_keys=True)).alias("parameters"),
        F.lit(folds).alias("calibration_folds"), F.lit(float(threshold)).alias("threshold"),
        "training_rows", "prevalence", "content_hash", F.lit(len(checks)).alias("checks_passed"),
        F.lit(json.dumps(metadata or {}, sort_keys=True)).alias("governance"),
        F.current_timestamp().alias("trained_at"))
    write_report_json(meta, path.rstrip("/") + "/metadata_row")
    return meta


def score_files(spark, model, source: str, target: str, features: Sequence[str],
                threshold: float = 0.5) -> DataFrame:
    """CSV in, the same columns with probability, threshold and flag out."""
    from plumbline.sources.readers import read_table
    out = score(read_table(spark, source), model, threshold, features)
    out.write.mode("overwrite").option("header", True).csv(target)
    return spark.read.option("header", True).schema(out.schema).csv(target)
