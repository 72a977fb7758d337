"""Metrics of a prediction table ``(id, y, p[, keys])``.

Every operator takes optional group keys, so one job evaluates all splits,
models or methods at once. Null labels and scores are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import (
    attach_scalars, decision_tree_index, number, quoted, ratio,
)
from plumbline.functions.ordered import quantiles, running_totals

# Cost scenarios (false positive cost, false negative cost).
COST_SCENARIOS = {
    "balanced_1_to_1": (1.0, 1.0),
    "moderate_detection_2_to_1": (1.0, 2.0),
    "high_detection_5_to_1": (1.0, 5.0),
    "very_high_detection_10_to_1": (1.0, 10.0),
}
# Probability bands [lower, upper).
PROBABILITY_BANDS = ((0.00, 0.10), (0.10, 0.15), (0.15, 0.20), (0.20, 0.25),
                     (0.25, 0.30), (0.30, 0.40), (0.40, 0.50), (0.50, 1.01))


def percent_grid(start: int, stop: int, step: int) -> list[float]:
    """Thresholds from whole percents, ends included: exact on every engine."""
    return [i / 100 for i in range(start, stop + 1, step)]


def linspace_edges(bins: int) -> list[float]:
    """Edges of equal bins of [0, 1] as i * (1 / bins), the last one exactly 1."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def scored(pred: DataFrame, keys: Sequence[str] = (), label: str = "y", score: str = "p") -> DataFrame:
    """Keys, label as long and score as double; unusable rows removed."""
    return pred.select(*[quoted(k) for k in keys], quoted(label).cast("long").alias("y"),
                       number(score).alias("p")).filter(F.col("y").isNotNull() & F.col("p").isNotNull())


_RATES = {
    "precision": "coalesce(try_divide(double(tp), tp + fp), 0D)",
    "recall": "coalesce(try_divide(double(tp), tp + fn), 0D)",
    "f1": "coalesce(try_divide(double(2 * tp), 2 * tp + fp + fn), 0D)",
    "specificity": "coalesce(try_divide(double(tn), tn + fp), 0D)",
    # With only one class present, balanced accuracy is the recall of that class.
    "balanced_accuracy": "CASE WHEN tp + fn = 0 THEN coalesce(try_divide(double(tn), tn + fp), 0D) "
                         "WHEN tn + fp = 0 THEN double(tp) / (tp + fn) "
                         "ELSE (double(tp) / (tp + fn) + double(tn) / (tn + fp)) / 2 END",
    "accuracy": "coalesce(try_divide(double(tp + tn), tp + fp + tn + fn), 0D)",
    "false_positive_rate": "coalesce(try_divide(double(fp), fp + tn), 0D)",
    "false_negative_rate": "coalesce(try_divide(double(fn), fn + tp), 0D)",
    "predicted_positive_rate": "coalesce(try_divide(double(tp + fp), tp + fp + tn + fn), 0D)",
    "predicted_positive_percent": "coalesce(try_divide(double(tp + fp), tp + fp + tn + fn), 0D) * 100",
    "flagged_per_1000": "coalesce(try_divide(double(tp + fp), tp + fp + tn + fn), 0D) * 1000",
}


def with_rates(df: DataFrame) -> DataFrame:
    """Add the usual rates to columns tp, fp, tn, fn; zero where undefined."""
    return df.selectExpr("*", *[f"{e} AS {name}" for name, e in _RATES.items()])


def confusion(pred: DataFrame, threshold: float, keys: Sequence[str] = (), label: str = "y",
              score: str = "p") -> DataFrame:
    """tn, fp, fn, tp at one threshold."""
    hit = F.col("p") >= F.lit(float(threshold))
    pos = F.col("y") == 1
    return scored(pred, keys, label, score).groupBy(*keys).agg(
        F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp"))


def threshold_metrics(pred: DataFrame, threshold: float, keys: Sequence[str] = (),
                      label: str = "y", score: str = "p") -> DataFrame:
    """Confusion counts and all rates at one threshold."""
    c = confusion(pred, threshold, keys, label, score)
    return with_rates(c.withColumn("threshold", F.lit(float(threshold))))


def threshold_sweep(pred: DataFrame, grid: Sequence[float], keys: Sequence[str] = (),
                    label: str = "y", score: str = "p") -> DataFrame:
    """Threshold metrics for a whole grid in one pass.

    Each row is counted once, in the interval between neighbouring thresholds its
    score falls into; the confusion counts of every threshold follow from sums over
    that small table. Rows are never multiplied by the grid.
    """
    grid = sorted(float(t) for t in grid)
    counts = scored(pred, keys, label, score).groupBy(
        *keys, decision_tree_index("p", grid).alias("__i")).agg(
        F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    # Per key at most len(grid) + 1 cells are collected.
    cells = counts.groupBy(*keys).agg(F.expr("collect_list(struct(__i, pos, n)) AS __c"),
                                      F.expr("sum(pos) AS __pos"), F.expr("sum(n) AS __n"))
    steps = ", ".join(f"struct({i + 1} AS i, {t!r}D AS threshold)" for i, t in enumerate(grid))

    def above(field: str) -> str:
        return f"aggregate(filter(__c, c -> c.__i >= __s.i), 0L, (acc, c) -> acc + c.{field})"

    named = [f"`{k}`" for k in keys]
    out = (cells.selectExpr("*", f"explode(array({steps})) AS __s")
           .selectExpr(*named, "__s.threshold AS threshold", "__pos", "__n", f"{above('pos')} AS tp", f"{above('n')} AS __hits")
           .selectExpr(*named, "threshold", "tp", "__hits - tp AS fp", "__n - __pos - __hits + tp AS tn", "__pos - tp AS fn"))
    return with_rates(out)


def _steps(pred: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    return running_totals(scored(pred, keys, label, score), "p",
                          {"pos": F.col("y"), "n": F.lit(1)}, keys)


def ranking_metrics(pred: DataFrame, keys: Sequence[str] = (), label: str = "y",
                    score: str = "p") -> DataFrame:
    """Exact ROC-AUC (ties count half) and step-wise average precision per key."""
    s = _steps(pred, keys, label, score)
    neg = F.col("n") - F.col("pos")
    neg_before = (F.col("n_before") - F.col("pos_before")).cast("double")
    p_all, n_all = F.col("pos_total").cast("double"), F.col("n_total").cast("double")
    wins = F.col("pos") * (neg_before + neg / 2.0)
    tp = p_all - F.col("pos_before")
    shown = n_all - F.col("n_before")
    agg = s.groupBy(*keys).agg(
        F.sum(wins).alias("__wins"), F.sum(F.col("pos") * tp / shown).alias("__ap"),
        F.max("pos_total").alias("__p"), F.max("n_total").alias("__n"))
    p, n = F.col("__p").cast("double"), F.col("__n").cast("double")
    return agg.select(*keys, ratio(F.col("__wins"), p * (n - p)).alias("roc_auc"),
                      ratio(F.col("__ap"), p, 0.0).alias("pr_auc"))


def roc_auc(pred: DataFrame, keys: Sequence[str] = (), label: str = "y", score: str = "p") -> DataFrame:
    return ranking_metrics(pred, keys, label, score).select(*keys, "roc_auc")


def average_precision(pred: DataFrame, keys: Sequence[str] = (), label: str = "y",
                      score: str = "p") -> DataFrame:
    return ranking_metrics(pred, keys, label, score).select(*keys, "pr_auc")


def _probability_aggregates(eps: float) -> list[Column]:
    y, p = F.col("y"), F.col("p")
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    loss = -(y * F.log(q) + (1 - y) * F.log(F.lit(1.0) - q))
    return [F.avg((p - y) * (p - y)).alias("brier_score"), F.avg(loss).alias("log_loss"),
            F.avg(p).alias("mean_probability"), F.avg(y).alias("observed_rate"),
            (F.avg(p) - F.avg(y)).alias("calibration_bias")]


def probability_metrics(pred: DataFrame, keys: Sequence[str] = (), label: str = "y",
                        score: str = "p", eps: float = 1e-15) -> DataFrame:
    """Brier score, clipped log-loss, mean score, observed rate and their difference."""
    return scored(pred, keys, label, score).groupBy(*keys).agg(*_probability_aggregates(eps))


def brier(pred: DataFrame, keys: Sequence[str] = (), label: str = "y", score: str = "p") -> DataFrame:
    return probability_metrics(pred, keys, label, score).select(*keys, "brier_score")


def log_loss(pred: DataFrame, keys: Sequence[str] = (), label: str = "y", score: str = "p",
             eps: float = 1e-15) -> DataFrame:
    return probability_metrics(pred, keys, label, score, eps).select(*keys, "log_loss")


def _bin_counts(pred: DataFrame, edges: Sequence[float], keys: Sequence[str], label: str,
                score: str) -> DataFrame:
    inner = list(edges[1:-1])
    rows = scored(pred, keys, label, score).filter(
        (F.col("p") >= F.lit(float(edges[0]))) & (F.col("p") <= F.lit(float(edges[-1]))))
    return rows.groupBy(*keys, decision_tree_index("p", inner).alias("__bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))


def calibration_bins(pred: DataFrame, bins: int = 10, keys: Sequence[str] = (), label: str = "y",
                     score: str = "p") -> DataFrame:
    """Equal bins of [0, 1], left-closed, the last one closed; empty bins are kept."""
    edges = linspace_edges(bins)
    counts = _bin_counts(pred, edges, keys, label, score)
    groups = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("__bin", F.struct("count", "mean_p", "rate")))).alias("__m"))
    frame = F.array(*[F.struct(F.lit(i + 1).alias("bin"), F.lit(edges[i]).alias("lower"),
                               F.lit(edges[i + 1]).alias("upper")) for i in range(bins)])
    cell = F.try_element_at("__m", F.col("__f.bin") - 1)
    return groups.select(*keys, F.explode(frame).alias("__f"), "__m").select(
        *keys, F.col("__f.bin").alias("bin"), F.col("__f.lower").alias("lower"),
        F.col("__f.upper").alias("upper"),
        F.coalesce(cell["count"], F.lit(0)).alias("count"),
        cell["mean_p"].alias("mean_predicted_probability"), cell["rate"].alias("observed_rate"),
        F.abs(cell["mean_p"] - cell["rate"]).alias("absolute_error"))


def ece(pred: DataFrame, bins: int = 10, keys: Sequence[str] = (), label: str = "y",
        score: str = "p") -> DataFrame:
    """Expected calibration error: count-weighted gap between score and observed rate."""
    gap = F.abs(F.col("mean_p") - F.col("rate"))
    return _bin_counts(pred, linspace_edges(bins), keys, label, score).groupBy(*keys).agg(
        ratio(F.sum(F.col("count") * gap), F.sum("count")).alias("expected_calibration_error"))


def calibration_curve(pred: DataFrame, bins: int = 10, strategy: str = "uniform",
                      label: str = "y", score: str = "p") -> DataFrame:
    """Reliability points of the non-empty bins, uniform or by score quantile.

    A score equal to an inner quantile edge belongs to the bin above it for uniform
    bins and below it for quantile bins.
    """
    if strategy == "uniform":
        b = _bin_counts(pred, linspace_edges(bins), (), label, score)
    else:
        rows = scored(pred, (), label, score)
        q = quantiles(rows.withColumnRenamed("p", "value"), "value",
                      [i / bins for i in range(1, bins)]).select("q")
        b = (attach_scalars(rows, q)
             .groupBy(F.size(F.filter("q", lambda e: e < F.col("p"))).alias("__bin"))
             .agg(F.count(F.lit(1)).alias("count"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate")))
    return b.select((F.col("__bin") + 1).alias("bin"), "count",
                    F.col("mean_p").alias("mean_predicted_probability"), F.col("rate").alias("observed_rate"))


def curve_points(pred: DataFrame, keys: Sequence[str] = (), label: str = "y",
                 score: str = "p") -> DataFrame:
    """ROC and precision-recall point for every distinct score used as threshold."""
    s = _steps(pred, keys, label, score)
    tp = F.col("pos_total") - F.col("pos_before")
    shown = F.col("n_total") - F.col("n_before")
    fp = shown - tp
    recall = ratio(tp, F.col("pos_total"), 0.0)
    return s.select(*keys, F.col("p").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
                    recall.alias("tpr"), ratio(fp, F.col("n_total") - F.col("pos_total"), 0.0).alias("fpr"),
                    ratio(tp, shown, 0.0).alias("precision"))


def classification_report(pred: DataFrame, threshold: float, keys: Sequence[str] = (),
                          label: str = "y", score: str = "p") -> DataFrame:
    """Precision, recall, f1 and support per class with macro and weighted averages."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def one(hit: Column, wrong: Column, missed: Column) -> tuple[Column, Column, Column, Column]:
        return (ratio(hit, hit + wrong, 0.0), ratio(hit, hit + missed, 0.0),
                ratio(2 * hit, 2 * hit + wrong + missed, 0.0), hit + missed)

    zero, one_ = one(tn, fn, fp), one(tp, fp, fn)
    n = tp + fp + tn + fn
    macro = [(a + b) / 2 for a, b in zip(zero[:3], one_[:3])]
    weighted = [ratio(a * zero[3] + b * one_[3], n, 0.0) for a, b in zip(zero[:3], one_[:3])]
    rows = [("0", *zero), ("1", *one_), ("macro avg", *macro, n), ("weighted avg", *weighted, n)]
    structs = [F.struct(F.lit(c).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), s.cast("long").alias("support")) for c, p, r, f, s in rows]
    return confusion(pred, threshold, keys, label, score).select(*keys, F.inline(F.array(*structs)))


def probability_bands(pred: DataFrame, bands: Sequence[tuple[float, float]] = PROBABILITY_BANDS,
                      label: str = "y", score: str = "p") -> DataFrame:
    """Rows, observed rate in % and mean score per band [lower, upper); empty bands kept.

    One conditional aggregation per band in a single scan.
    """
    y, p = F.col("y"), F.col("p")

    def band(lo: float, hi: float) -> Column:
        inside = (p >= F.lit(float(lo))) & (p < F.lit(float(hi)))
        return F.struct(F.lit(float(lo)).alias("lower"), F.lit(float(hi)).alias("upper"),
                        F.count_if(inside).alias("rows"),
                        (F.avg(F.when(inside, y)) * 100).alias("observed_rate_percent"),
                        F.avg(F.when(inside, p)).alias("mean_probability"))

    return scored(pred, (), label, score).agg(
        F.array(*[band(lo, hi) for lo, hi in bands]).alias("b")).select(F.inline("b"))


#: Selection rules: filter on the sweep, then sort keys; the threshold always breaks ties.
SELECTION_RULES: dict[str, tuple[str | None, tuple[str, ...]]] = {
    "best_f1": (None, ("-f1", "threshold")),
    "best_recall": (None, ("-recall", "threshold")),
    "best_precision": (None, ("-precision", "threshold")),
    "best_accuracy": (None, ("-accuracy", "threshold")),
    "f1_balanced": (None, ("-f1", "-balanced_accuracy", "-recall", "distance", "threshold")),
    "f1_conservative": (None, ("-f1", "-recall", "-specificity", "-threshold")),
    "high_recall_precision_30": ("precision >= 0.30", ("-recall", "threshold")),
    "precision_priority_recall_60": ("recall >= 0.60", ("-precision", "threshold")),
    "specificity_priority_recall_50": ("recall >= 0.50", ("-specificity", "threshold")),
}


def select_threshold(sweep: DataFrame, rules: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The chosen sweep row per rule (and key); a rule nothing satisfies yields no row."""
    cols = sweep.columns
    picks = []
    for rule in rules:
        condition, order = SELECTION_RULES[rule]
        ok = F.expr(condition or "true")
        sort = F.struct(*[-F.col(o[1:]) if o[0] == "-" else F.col(o) for o in order])
        best = F.min_by(F.struct(*cols), F.when(ok, sort))
        picks.append(F.struct(F.lit(rule).alias("rule"), best.alias("row")))
    rows = sweep.withColumn("distance", F.abs(F.col("threshold") - F.lit(0.5)))
    chosen = rows.groupBy(*keys).agg(F.array(*picks).alias("__picks")).select(F.inline("__picks"))
    return chosen.filter(F.col("row").isNotNull()).select("rule", "row.*")


def compare_operating_points(a: DataFrame, threshold_a: float, b: DataFrame, threshold_b: float,
                             label: str = "y", score: str = "p") -> DataFrame:
    """Every threshold metric of two (scores, threshold) choices with the change."""
    names = ["threshold", "tp", "fp", "tn", "fn", "f1", "precision", "recall", "specificity",
             "balanced_accuracy", "accuracy", "predicted_positive_percent", "flagged_per_1000"]

    def side(df: DataFrame, t: float, s: str) -> DataFrame:
        m = threshold_metrics(df, t, (), label, score)
        return m.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(s)) for c in names])))

    return side(a, threshold_a, "value_a").join(side(b, threshold_b, "value_b"), "metric").withColumn(
        "delta", F.col("value_b") - F.col("value_a"))


def business_metrics(sweep: DataFrame, prevalence: float | Column) -> DataFrame:
    """Capacity view of a sweep: flagged share against prevalence, errors per 1000, percents."""
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    prev = prevalence if isinstance(prevalence, Column) else F.lit(float(prevalence))
    return sweep.withColumns({
        "predicted_vs_prevalence": ratio(F.col("predicted_positive_rate"), prev),
        "false_positives_per_1000": ratio(F.col("fp"), n, 0.0) * 1000,
        "false_negatives_per_1000": ratio(F.col("fn"), n, 0.0) * 1000,
        "precision_percent": F.col("precision") * 100, "recall_percent": F.col("recall") * 100,
        "specificity_percent": F.col("specificity") * 100})


def add_costs(sweep: DataFrame, scenarios: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Cost of the errors of every sweep row under each scenario, in total and per row."""
    scenarios = scenarios or COST_SCENARIOS
    array = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(a).alias("false_positive_cost"),
                               F.lit(b).alias("false_negative_cost")) for s, (a, b) in scenarios.items()])
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    total = F.col("fp") * F.col("false_positive_cost") + F.col("fn") * F.col("false_negative_cost")
    return sweep.select("*", F.inline(array)).withColumn("total_cost", total).withColumn(
        "cost_per_row", ratio(F.col("total_cost"), n))


def cheapest_threshold(costs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Least-cost sweep row per scenario (lowest threshold on ties) and whether the
    choice depends on the scenario."""
    cols = [c for c in costs.columns if c not in keys and c != "scenario"]
    best = costs.groupBy(*keys, "scenario").agg(
        F.min_by(F.struct(*cols), F.struct("total_cost", "threshold")).alias("b")).select(
        *keys, "scenario", "b.*")
    w = Window.partitionBy(*keys, F.lit(0))  # a handful of scenarios per key
    return best.withColumn("threshold_varies", F.min("threshold").over(w) < F.max("threshold").over(w))


def metric_gap(cv: DataFrame, holdout: DataFrame, metrics: Sequence[str], key: str = "model") -> DataFrame:
    """Hold-out minus cross-validation for each metric, per model."""
    a = cv.select(key, *[F.col(m).alias(f"cv_{m}") for m in metrics])
    b = holdout.select(key, *[F.col(m).alias(f"holdout_{m}") for m in metrics])
    return a.join(b, key).withColumns({f"gap_{m}": F.col(f"holdout_{m}") - F.col(f"cv_{m}") for m in metrics})


def model_comparison(pred: DataFrame, thresholds: dict[str, float], keys: Sequence[str] = ("method",),
                     bins: int = 10, label: str = "y", score: str = "p", eps: float = 1e-15) -> DataFrame:
    """Ranking, probability, calibration and threshold metrics per method.

    ``thresholds`` maps the first key's values to operating thresholds. Everything
    but the ranking and the bins comes out of one aggregation.
    """
    first = keys[0]
    table = F.create_map(*[F.lit(x) for m, t in thresholds.items() for x in (m, float(t))])
    rows = scored(pred, keys, label, score)
    limit = F.try_element_at(table, F.col(first))
    hit = F.col("p") >= limit
    pos = F.col("y") == 1
    base = rows.groupBy(*keys).agg(
        *_probability_aggregates(eps), F.count_if(~hit & ~pos).alias("tn"),
        F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"),
        F.count_if(hit & pos).alias("tp"))
    out = with_rates(base.withColumn("threshold", F.try_element_at(table, F.col(first))))
    return (out.join(ranking_metrics(rows, keys), list(keys))
            .join(ece(rows, bins, keys), list(keys)))


def split_performance(pred: DataFrame, keys: Sequence[str] = ("split", "method"), bins: int = 10,
                      label: str = "y", score: str = "p", eps: float = 1e-7) -> DataFrame:
    """Ranking, probability and calibration metrics per (split, method)."""
    rows = scored(pred, keys, label, score)
    return (probability_metrics(rows, keys, eps=eps).join(ranking_metrics(rows, keys), list(keys))
            .join(ece(rows, bins, keys), list(keys)))
