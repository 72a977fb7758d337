"""Metrics, thresholds, costs, rules and result tables over the prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import calibrate, compare, importance, metrics, models, profile, rules, splits
from plumbline.plans import datasets as d
from plumbline.plans.registry import query

Spark = SparkSession

COUNTS = """count(*) FILTER (p >= {t} AND y = 1) AS tp, count(*) FILTER (p >= {t} AND y = 0) AS fp,
  count(*) FILTER (p < {t} AND y = 0) AS tn, count(*) FILTER (p < {t} AND y = 1) AS fn"""
RATES = """coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
  coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 AS balanced_accuracy,
  (tp + tn) / (tp + fp + tn + fn) AS accuracy, fp / (fp + tn) AS false_positive_rate, fn / (fn + tp) AS false_negative_rate,
  (tp + fp) / (tp + fp + tn + fn) AS predicted_positive_rate, 100.0 * (tp + fp) / (tp + fp + tn + fn) AS predicted_positive_percent,
  1000.0 * (tp + fp) / (tp + fp + tn + fn) AS flagged_per_1000"""
RATE_NAMES = ("precision recall f1 specificity balanced_accuracy accuracy false_positive_rate false_negative_rate "
              "predicted_positive_rate predicted_positive_percent flagged_per_1000")
CELLS = "tp fp tn fn"
GRID = metrics.percent_grid(5, 95, 5)

SWEEP = f"""grid AS (SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM range(5, 96, 5) AS r(i)),
 cells AS (SELECT threshold, {COUNTS.format(t='threshold')} FROM pred, grid GROUP BY threshold),
 sweep AS (SELECT *, {RATES} FROM cells)"""


def _sweep(spark: Spark, sf: str) -> DataFrame:
    return metrics.threshold_sweep(d.predictions(spark, sf), GRID)


def auc_sql(src: str, *keys: str) -> str:
    """CTE ``auc(keys, roc_auc, pr_auc)`` over a table with y and p."""
    k = ", ".join(keys)
    by = f"{k}, " if keys else ""
    part = f"PARTITION BY {k}" if keys else ""
    return f"""by_p AS (SELECT {by}p, sum(y) AS pos, count(*) AS n FROM {src} GROUP BY {by}p),
 cum AS (SELECT *, sum(n - pos) OVER (w) - (n - pos) AS nb, sum(pos) OVER (v) AS tp, sum(n) OVER (v) AS shown,
   sum(pos) OVER ({part}) AS ap, sum(n) OVER ({part}) AS an FROM by_p WINDOW w AS ({part} ORDER BY p), v AS ({part} ORDER BY p DESC)),
 auc AS (SELECT {by}sum(pos * (nb + (n - pos) / 2.0)) / (CAST(any_value(ap) AS DOUBLE) * any_value(an - ap)) AS roc_auc,
   sum(pos * tp / shown) / any_value(ap) AS pr_auc FROM cum {'GROUP BY ' + k if keys else ''})"""


def bins_sql(src: str, *keys: str) -> str:
    """CTEs ``bins`` (non-empty calibration bins) and ``ece``."""
    by = "".join(f"{k}, " for k in keys)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    edges = ", ".join(repr(e) for e in metrics.linspace_edges(10)[1:-1])
    return f"""bins AS (SELECT {by}len(list_filter([{edges}], lambda t: CAST(t AS DOUBLE) <= p)) + 1 AS bin, count(*) AS count, avg(p) AS mean_p, avg(y) AS rate FROM {src} GROUP BY ALL),
 ece AS (SELECT {by}sum(count * abs(mean_p - rate)) / sum(count) AS expected_calibration_error FROM bins {group})"""


def prob_sql(src: str, eps: str, *keys: str) -> str:
    by = "".join(f"{k}, " for k in keys)
    q = f"least(greatest(p, {eps}), 1 - {eps})"
    return f"""prob AS (SELECT {by}avg(power(p - y, 2)) AS brier_score, -avg(y * ln({q}) + (1 - y) * ln(1 - {q})) AS log_loss,
  avg(p) AS mean_probability, avg(y) AS observed_rate, avg(p) - avg(y) AS calibration_bias FROM {src} {'GROUP BY ' + ', '.join(keys) if keys else ''})"""


PROB_NAMES = "brier_score log_loss mean_probability observed_rate calibration_bias"


@query("e1_confusion", f"WITH {d.PRED} SELECT {COUNTS.format(t='0.25')} FROM pred", longs=CELLS)
def e1(spark: Spark, sf: str) -> DataFrame:
    return metrics.confusion(d.predictions(spark, sf), 0.25)


@query("e2_threshold_metrics", f"WITH {d.METHODS}, c AS (SELECT method, {COUNTS.format(t='0.44')} FROM preds GROUP BY method) SELECT *, 0.44 AS threshold, {RATES} FROM c",
       doubles="threshold " + RATE_NAMES, longs=CELLS)
def e2(spark: Spark, sf: str) -> DataFrame:
    return metrics.threshold_metrics(d.method_predictions(spark, sf), 0.44, ["method"])


@query("e3_threshold_sweep", f"WITH {d.PRED}, {SWEEP} SELECT * FROM sweep", doubles="threshold " + RATE_NAMES, longs=CELLS)
def e3(spark: Spark, sf: str) -> DataFrame:
    return _sweep(spark, sf)


@query("e3_threshold_sweep_by_split", f"""WITH {d.METHODS}, grid AS (SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM range(5, 96) AS r(i)),
 c AS (SELECT method, split, threshold, {COUNTS.format(t='threshold')} FROM preds, grid GROUP BY method, split, threshold) SELECT *, {RATES} FROM c""",
       doubles="threshold " + RATE_NAMES, longs=CELLS + " split")
def e3b(spark: Spark, sf: str) -> DataFrame:
    return metrics.threshold_sweep(d.method_predictions(spark, sf), metrics.percent_grid(5, 95, 1), ["method", "split"])


@query("e4_roc_auc", f"WITH {d.METHODS}, {auc_sql('preds', 'method')} SELECT method, roc_auc FROM auc", doubles="roc_auc")
def e4(spark: Spark, sf: str) -> DataFrame:
    return metrics.roc_auc(d.method_predictions(spark, sf), ["method"])


@query("e5_average_precision", f"WITH {d.PRED}, {auc_sql('pred')} SELECT pr_auc FROM auc", doubles="pr_auc")
def e5(spark: Spark, sf: str) -> DataFrame:
    return metrics.average_precision(d.predictions(spark, sf))


@query("e6_brier", f"WITH {d.METHODS}, {prob_sql('preds', '1e-15', 'method')} SELECT method, brier_score FROM prob", doubles="brier_score")
def e6(spark: Spark, sf: str) -> DataFrame:
    return metrics.brier(d.method_predictions(spark, sf), ["method"])


@query("e7_log_loss", f"WITH {d.METHODS}, {prob_sql('preds', '1e-7', 'method')} SELECT method, log_loss FROM prob", doubles="log_loss")
def e7(spark: Spark, sf: str) -> DataFrame:
    return metrics.log_loss(d.method_predictions(spark, sf), ["method"], eps=1e-7)


@query("e8_ece", f"WITH {d.METHODS}, {bins_sql('preds', 'method')} SELECT * FROM ece", doubles="expected_calibration_error")
def e8(spark: Spark, sf: str) -> DataFrame:
    return metrics.ece(d.method_predictions(spark, sf), 10, ["method"])


_EDGES = metrics.linspace_edges(10)


@query("e9_calibration_bins", f"""WITH {d.METHODS}, {bins_sql('preds', 'method')}, frame AS (SELECT method, bin, lower, upper FROM (SELECT DISTINCT method FROM preds) AS m,
  (VALUES {', '.join(f'({i + 1}, {_EDGES[i]!r}, {_EDGES[i + 1]!r})' for i in range(10))}) AS v(bin, lower, upper))
SELECT f.method, f.bin, lower, upper, coalesce(count, 0) AS count, mean_p AS mean_predicted_probability, rate AS observed_rate, abs(mean_p - rate) AS absolute_error
FROM frame f LEFT JOIN bins b ON f.method = b.method AND f.bin = b.bin""",
       doubles="lower upper mean_predicted_probability observed_rate absolute_error", longs="bin count")
def e9(spark: Spark, sf: str) -> DataFrame:
    return metrics.calibration_bins(d.method_predictions(spark, sf), 10, ["method"])


@query("e10_calibration_curve_uniform", f"WITH {d.PRED}, {bins_sql('pred')} SELECT bin, count, mean_p AS mean_predicted_probability, rate AS observed_rate FROM bins",
       doubles="mean_predicted_probability observed_rate", longs="bin count")
def e10(spark: Spark, sf: str) -> DataFrame:
    return metrics.calibration_curve(d.predictions(spark, sf), 10, "uniform")


@query("e10_calibration_curve_quantile", f"""WITH {d.PRED}, q AS (SELECT quantile_cont(p, [{', '.join(str(i / 10) for i in range(1, 10))}]) AS e FROM pred)
SELECT len(list_filter(e, lambda t: t < p)) + 1 AS bin, count(*) AS count, avg(p) AS mean_predicted_probability, avg(y) AS observed_rate FROM pred, q GROUP BY 1""",
       doubles="mean_predicted_probability observed_rate", longs="bin count")
def e10b(spark: Spark, sf: str) -> DataFrame:
    return metrics.calibration_curve(d.predictions(spark, sf), 10, "quantile")


@query("e11_curve_points", f"""WITH {d.PRED}, {auc_sql('pred')} SELECT p AS threshold, tp, shown - tp AS fp, tp / ap AS tpr, (shown - tp) / (an - ap) AS fpr, tp / shown AS precision FROM cum""",
       doubles="threshold tpr fpr precision", longs="tp fp")
def e11(spark: Spark, sf: str) -> DataFrame:
    return metrics.curve_points(d.predictions(spark, sf))


@query("e12_classification_report", f"""WITH {d.PRED}, c AS (SELECT {COUNTS.format(t='0.3')} FROM pred),
 r AS (SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fn + fp) AS f0, tn + fp AS s0,
   tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fp + fn) AS f1, tp + fn AS s1 FROM c)
SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM r UNION ALL SELECT '1', p1, r1, f1, s1 FROM r
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM r
UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1), (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM r""",
       doubles="precision recall f1", longs="support")
def e12(spark: Spark, sf: str) -> DataFrame:
    return metrics.classification_report(d.predictions(spark, sf), 0.3)


@query("e13_probability_bands", f"""WITH {d.PRED}, b(lower, upper) AS (VALUES {', '.join(f'(CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))' for lo, hi in metrics.PROBABILITY_BANDS)})
SELECT lower, upper, count(p) AS rows, avg(y) * 100 AS observed_rate_percent, avg(p) AS mean_probability FROM b LEFT JOIN pred ON p >= lower AND p < upper GROUP BY lower, upper""",
       doubles="lower upper observed_rate_percent mean_probability", longs="rows")
def e13(spark: Spark, sf: str) -> DataFrame:
    return metrics.probability_bands(d.predictions(spark, sf))


_ORDER = {"best_f1": ("", "f1 DESC, threshold"), "best_recall": ("", "recall DESC, threshold"), "best_precision": ("", "precision DESC, threshold"),
          "best_accuracy": ("", "accuracy DESC, threshold"),
          "f1_balanced": ("", "f1 DESC, balanced_accuracy DESC, recall DESC, abs(threshold - 0.5), threshold"),
          "f1_conservative": ("", "f1 DESC, recall DESC, specificity DESC, threshold DESC"),
          "high_recall_precision_30": ("WHERE precision >= 0.3", "recall DESC, threshold"),
          "precision_priority_recall_60": ("WHERE recall >= 0.6", "precision DESC, threshold"),
          "specificity_priority_recall_50": ("WHERE recall >= 0.5", "specificity DESC, threshold")}


@query("e14_select_threshold", f"WITH {d.PRED}, {SWEEP} " + " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{r}' AS rule, * FROM sweep {w} ORDER BY {o} LIMIT 1) AS q_{r}" for r, (w, o) in _ORDER.items()),
       doubles="threshold " + RATE_NAMES, longs=CELLS)
def e14(spark: Spark, sf: str) -> DataFrame:
    return metrics.select_threshold(_sweep(spark, sf), list(metrics.SELECTION_RULES))


_POINT = ["threshold", "tp", "fp", "tn", "fn", "f1", "precision", "recall", "specificity", "balanced_accuracy", "accuracy", "predicted_positive_percent", "flagged_per_1000"]


@query("e15_compare_operating_points", f"""WITH {d.METHODS}, c AS (SELECT 'a' AS side, 0.44 AS threshold, {COUNTS.format(t='0.44')} FROM preds WHERE method = 'base'
  UNION ALL SELECT 'b', 0.25, {COUNTS.format(t='0.25')} FROM preds WHERE method = 'sigmoid'), m AS (SELECT *, {RATES} FROM c),
 u AS ({' UNION ALL '.join(f"SELECT side, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM m" for m in _POINT)})
SELECT a.metric, a.v AS value_a, b.v AS value_b, b.v - a.v AS delta FROM (SELECT * FROM u WHERE side = 'a') AS a JOIN (SELECT * FROM u WHERE side = 'b') AS b ON a.metric = b.metric""",
       doubles="value_a value_b delta")
def e15(spark: Spark, sf: str) -> DataFrame:
    p = d.method_predictions(spark, sf)
    return metrics.compare_operating_points(p.filter("method = 'base'"), 0.44, p.filter("method = 'sigmoid'"), 0.25)


@query("e16_business_metrics", f"""WITH {d.PRED}, {SWEEP}
SELECT threshold, predicted_positive_rate / (SELECT avg(y) FROM pred) AS predicted_vs_prevalence, 1000.0 * fp / (tp + fp + tn + fn) AS false_positives_per_1000,
  1000.0 * fn / (tp + fp + tn + fn) AS false_negatives_per_1000, precision * 100 AS precision_percent, recall * 100 AS recall_percent, specificity * 100 AS specificity_percent FROM sweep""",
       doubles="threshold predicted_vs_prevalence false_positives_per_1000 false_negatives_per_1000 precision_percent recall_percent specificity_percent")
def e16(spark: Spark, sf: str) -> DataFrame:
    prevalence = d.predictions(spark, sf).agg(F.avg("y").alias("m")).scalar()
    return metrics.business_metrics(_sweep(spark, sf), prevalence).select(
        "threshold", "predicted_vs_prevalence", "false_positives_per_1000", "false_negatives_per_1000",
        "precision_percent", "recall_percent", "specificity_percent")


COSTS = f"""{SWEEP}, scen(scenario, false_positive_cost, false_negative_cost) AS (VALUES {', '.join(f"('{s}', {a}, {b})" for s, (a, b) in metrics.COST_SCENARIOS.items())}),
 costs AS (SELECT *, fp * false_positive_cost + fn * false_negative_cost AS total_cost,
   (fp * false_positive_cost + fn * false_negative_cost) / (tp + fp + tn + fn) AS cost_per_row FROM sweep, scen)"""
COST_NAMES = "threshold false_positive_cost false_negative_cost total_cost cost_per_row " + RATE_NAMES


@query("e17_add_costs", f"WITH {d.PRED}, {COSTS} SELECT * FROM costs", doubles=COST_NAMES, longs=CELLS)
def e17(spark: Spark, sf: str) -> DataFrame:
    return metrics.add_costs(_sweep(spark, sf))


@query("e18_cheapest_threshold", f"""WITH {d.PRED}, {COSTS}, r AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY total_cost, threshold) AS k FROM costs)
SELECT * EXCLUDE (k), (SELECT count(DISTINCT threshold) > 1 FROM r WHERE k = 1) AS threshold_varies FROM r WHERE k = 1""", doubles=COST_NAMES, longs=CELLS)
def e18(spark: Spark, sf: str) -> DataFrame:
    return metrics.cheapest_threshold(metrics.add_costs(_sweep(spark, sf)))


@query("e19_metric_gap", f"""WITH {d.METHODS}, c AS (SELECT method, split = 5 AS held, {COUNTS.format(t='0.3')} FROM preds GROUP BY ALL), m AS (SELECT *, {RATES} FROM c)
SELECT a.method AS model, a.f1 AS cv_f1, a.precision AS cv_precision, a.recall AS cv_recall, b.f1 AS holdout_f1, b.precision AS holdout_precision, b.recall AS holdout_recall,
  b.f1 - a.f1 AS gap_f1, b.precision - a.precision AS gap_precision, b.recall - a.recall AS gap_recall FROM m a JOIN m b ON a.method = b.method AND NOT a.held AND b.held""",
       doubles="cv_f1 cv_precision cv_recall holdout_f1 holdout_precision holdout_recall gap_f1 gap_precision gap_recall")
def e19(spark: Spark, sf: str) -> DataFrame:
    p = d.method_predictions(spark, sf).withColumnRenamed("method", "model")
    return metrics.metric_gap(metrics.threshold_metrics(p.filter("split <> 5"), 0.3, ["model"]),
                              metrics.threshold_metrics(p.filter("split = 5"), 0.3, ["model"]), ["f1", "precision", "recall"])


THRESHOLDS = {"base": 0.44, "sigmoid": 0.25, "isotonic": 0.3}
COMPARISON = f"""{auc_sql('preds', 'method')}, {bins_sql('preds', 'method')}, {prob_sql('preds', '1e-15', 'method')},
 c AS (SELECT method, {COUNTS.format(t="CASE method WHEN 'base' THEN 0.44 WHEN 'sigmoid' THEN 0.25 ELSE 0.3 END")} FROM preds GROUP BY method),
 comparison AS (SELECT method, prob.* EXCLUDE (method), tp, fp, tn, fn, CASE method WHEN 'base' THEN 0.44 WHEN 'sigmoid' THEN 0.25 ELSE 0.3 END AS threshold, {RATES}, roc_auc, pr_auc,
   expected_calibration_error FROM c JOIN prob USING (method) JOIN auc USING (method) JOIN ece USING (method))"""
COMPARISON_NAMES = f"{PROB_NAMES} threshold {RATE_NAMES} roc_auc pr_auc expected_calibration_error"


def _comparison(spark: Spark, sf: str) -> DataFrame:
    return metrics.model_comparison(d.method_predictions(spark, sf), THRESHOLDS)


@query("e20_model_comparison", f"WITH {d.METHODS}, {COMPARISON} SELECT * FROM comparison", doubles=COMPARISON_NAMES, longs=CELLS)
def e20(spark: Spark, sf: str) -> DataFrame:
    return _comparison(spark, sf)


SPLITS = f"{auc_sql('preds', 'split', 'method')}, {bins_sql('preds', 'split', 'method')}, {prob_sql('preds', '1e-7', 'split', 'method')}"


@query("e21_split_performance", f"""WITH {d.METHODS}, {SPLITS}
SELECT * FROM prob JOIN auc USING (split, method) JOIN ece USING (split, method)""", doubles=f"{PROB_NAMES} roc_auc pr_auc expected_calibration_error", longs="split")
def e21(spark: Spark, sf: str) -> DataFrame:
    return metrics.split_performance(d.method_predictions(spark, sf))


# --- result tables derived from the per-split metrics ---------------------------------------------

def _split_auc(spark: Spark, sf: str) -> DataFrame:
    return metrics.ranking_metrics(d.method_predictions(spark, sf), ["split", "method"])


AUCS = auc_sql("preds", "split", "method")


@query("a16_split_summary", f"WITH {d.METHODS}, {AUCS} " + " UNION ALL ".join(
    f"SELECT method, '{m}' AS metric, count({m}) AS splits, avg({m}) AS mean, stddev_samp({m}) AS std, min({m}) AS min, max({m}) AS max, quantile_cont({m}, 0.5) AS median, "
    f"quantile_cont({m}, 0.1) AS p10, quantile_cont({m}, 0.9) AS p90, avg(CAST({m} < 0.6 AS INT)) AS share_below_floor FROM auc GROUP BY method" for m in ("roc_auc", "pr_auc")),
       doubles="mean std min max median p10 p90 share_below_floor", longs="splits")
def a16(spark: Spark, sf: str) -> DataFrame:
    return profile.split_summary(_split_auc(spark, sf), ["method"], ["roc_auc", "pr_auc"])


@query("j6_paired_split_compare", f"""WITH {d.METHODS}, {AUCS}, x AS (SELECT b.roc_auc - a.roc_auc AS d FROM auc a JOIN auc b ON a.split = b.split AND a.method = 'base' AND b.method = 'isotonic')
SELECT count(*) AS splits, avg(CAST(d > 0 AS INT)) AS better_share, avg(CAST(d >= 0 AS INT)) AS equal_or_better_share, avg(d) AS mean_delta, quantile_cont(d, 0.5) AS median_delta,
  min(d) AS min_delta, max(d) AS max_delta FROM x""", doubles="better_share equal_or_better_share mean_delta median_delta min_delta max_delta", longs="splits")
def j6(spark: Spark, sf: str) -> DataFrame:
    return compare.paired_split_compare(_split_auc(spark, sf), "method", "base", "isotonic", "roc_auc")


@query("j7_attach_metrics", f"WITH {d.METHODS}, {prob_sql('preds', '1e-15', 'method')}, {bins_sql('preds', 'method')} SELECT prob.*, expected_calibration_error FROM prob LEFT JOIN ece USING (method)",
       doubles=f"{PROB_NAMES} expected_calibration_error")
def j7(spark: Spark, sf: str) -> DataFrame:
    p = d.method_predictions(spark, sf)
    return compare.attach_metrics(metrics.probability_metrics(p, ["method"]), metrics.ece(p, 10, ["method"]))


@query("j10_holdout_percentile", f"""WITH {d.METHODS}, {AUCS}, f AS (SELECT method AS model, roc_auc AS fixed_score FROM auc WHERE split = 5)
SELECT model, fixed_score, count(*) AS splits, avg(roc_auc) AS mean_score, avg(CAST(roc_auc < fixed_score AS INT)) AS share_below_fixed
FROM auc JOIN f ON auc.method = f.model WHERE split <> 5 GROUP BY model, fixed_score""", doubles="fixed_score mean_score share_below_fixed", longs="splits")
def j10(spark: Spark, sf: str) -> DataFrame:
    r = _split_auc(spark, sf).withColumnRenamed("method", "model")
    return compare.holdout_percentile(r.filter("split <> 5"), r.filter("split = 5"), "roc_auc")


RANKED = f"""{AUCS}, means AS (SELECT method AS model, round(avg(roc_auc), 9) AS roc_auc_mean, round(avg(pr_auc), 9) AS pr_auc_mean FROM auc GROUP BY method),
 ranked AS (SELECT *, row_number() OVER (ORDER BY roc_auc_mean DESC, pr_auc_mean DESC, model) AS rank FROM means)"""


def _ranked(spark: Spark, sf: str) -> DataFrame:
    means = _split_auc(spark, sf).groupBy(F.col("method").alias("model")).agg(
        F.round(F.avg("roc_auc"), 9).alias("roc_auc_mean"), F.round(F.avg("pr_auc"), 9).alias("pr_auc_mean"))
    return models.rank_models(means)


@query("h8_rank_models", f"WITH {d.METHODS}, {RANKED} SELECT * FROM ranked", doubles="roc_auc_mean pr_auc_mean", longs="rank")
def h8(spark: Spark, sf: str) -> DataFrame:
    return _ranked(spark, sf)


@query("h8_compare_with_baseline", f"""WITH {d.METHODS}, {RANKED}
SELECT model, 'roc_auc_mean' AS metric, 0.6258 AS baseline, roc_auc_mean AS value, roc_auc_mean - 0.6258 AS change FROM ranked WHERE rank = 1
UNION ALL SELECT model, 'pr_auc_mean', 0.3392, pr_auc_mean, pr_auc_mean - 0.3392 FROM ranked WHERE rank = 1""", doubles="baseline value change")
def h8b(spark: Spark, sf: str) -> DataFrame:
    return models.compare_with_baseline(_ranked(spark, sf), {"roc_auc_mean": 0.6258, "pr_auc_mean": 0.3392})


@query("h4_majority_baseline", f"""WITH {d.PRED}, m AS (SELECT CAST(avg(y) > 0.5 AS INT) AS majority FROM pred WHERE split <> 5),
 c AS (SELECT any_value(majority) AS majority, count(*) FILTER (majority = 0 AND y = 0) AS tn, count(*) FILTER (majority = 1 AND y = 0) AS fp,
   count(*) FILTER (majority = 0 AND y = 1) AS fn, count(*) FILTER (majority = 1 AND y = 1) AS tp FROM pred, m WHERE split = 5)
SELECT *, {RATES} FROM c""", doubles=RATE_NAMES, longs=CELLS + " majority")
def h4(spark: Spark, sf: str) -> DataFrame:
    p = d.predictions(spark, sf)
    return models.majority_baseline(p.filter("split <> 5"), p.filter("split = 5"))


@query("h9_oof_mean", f"WITH {d.METHODS} SELECT id, max(y) AS y, avg(p) AS p, count(p) AS predictions FROM preds GROUP BY id", doubles="p", longs="id y predictions")
def h9(spark: Spark, sf: str) -> DataFrame:
    return models.oof_mean(d.method_predictions(spark, sf), ["id"])


@query("h9_rows_without_prediction", f"WITH {d.OC} SELECT id FROM oc WHERE status <> 'F'", longs="id")
def h9b(spark: Spark, sf: str) -> DataFrame:
    oc = d.orders_customers(spark, sf)
    return models.rows_without_prediction(oc, oc.filter("status = 'F'").select("id"), ["id"])


# --- importance-like tables: |r| per split stands in for a fitted importance -----------------------

IMPORTANCE = " UNION ALL ".join(
    f"SELECT split, 'm' AS model, '{c}' AS feature, corr({e}, y) AS importance_mean FROM pred GROUP BY split"
    for c, e in (("price", "price"), ("balance", "balance"), ("p", "p"), ("building", "CAST(segment = 'BUILDING' AS INT)")))


def _importance(spark: Spark, sf: str) -> DataFrame:
    p = d.predictions(spark, sf).withColumn("building", (F.col("segment") == "BUILDING").cast("int"))
    from plumbline.operators.stats import point_biserial
    return point_biserial(p, ["price", "balance", "p", "building"], "y", ["split"]).select(
        "split", F.lit("m").alias("model"), "feature", F.col("r").alias("importance_mean"))


SELECTED = """w AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY importance_mean DESC, feature) AS rank, count(*) FILTER (importance_mean > 0) OVER (PARTITION BY split) AS npos FROM imp),
 q AS (SELECT split, quantile_cont(importance_mean, 0.75) AS cut FROM imp WHERE importance_mean > 0 GROUP BY split),
 a AS (SELECT w.*, importance_mean > 0 AND importance_mean >= cut AS above FROM w LEFT JOIN q ON w.split = q.split),
 s AS (SELECT *, count(*) FILTER (above) OVER (PARTITION BY split) AS n_above FROM a),
 selected AS (SELECT split, feature, importance_mean, rank FROM s WHERE CASE WHEN npos = 0 THEN rank <= 3 WHEN n_above >= 3 THEN above ELSE importance_mean > 0 AND rank <= 3 END)"""


@query("h18_select_features", f"WITH {d.PRED}, imp AS ({IMPORTANCE}), {SELECTED} SELECT * FROM selected", doubles="importance_mean", longs="split rank")
def h18(spark: Spark, sf: str) -> DataFrame:
    return importance.select_features(_importance(spark, sf), keys=["split"])


@query("h19_stability_score", f"""WITH {d.PRED}, imp AS ({IMPORTANCE}), {SELECTED},
 i AS (SELECT feature, avg(importance_mean) AS mean_importance, stddev_samp(importance_mean) AS std_importance, avg(CAST(importance_mean > 0 AS INT)) AS positive_importance_frequency,
   greatest(avg(CAST(importance_mean > 0 AS INT)), avg(CAST(importance_mean < 0 AS INT))) AS direction_consistency FROM imp GROUP BY feature),
 f AS (SELECT feature, count(*) / (SELECT count(DISTINCT split) FROM imp) AS sf FROM selected GROUP BY feature),
 n AS (SELECT i.*, coalesce(sf, 0) AS selection_frequency, greatest(mean_importance, 0) / (SELECT max(abs(mean_importance)) FROM i) AS normalized_importance FROM i LEFT JOIN f USING (feature))
SELECT *, mean_importance AS coefficient_mean, std_importance AS coefficient_std, CASE WHEN mean_importance > 0 THEN 'positive' ELSE 'negative' END AS dominant_direction,
  0.5 * selection_frequency + 0.3 * positive_importance_frequency + 0.2 * normalized_importance AS stability_score,
  CASE WHEN selection_frequency >= 0.7 THEN 'stable' WHEN selection_frequency >= 0.4 THEN 'moderately_stable' ELSE 'weak' END AS stability_class FROM n""",
       doubles="mean_importance std_importance positive_importance_frequency direction_consistency selection_frequency normalized_importance coefficient_mean coefficient_std stability_score")
def h19(spark: Spark, sf: str) -> DataFrame:
    imp = _importance(spark, sf)
    return importance.stability_score(imp, importance.select_features(imp, keys=["split"]),
                                      imp.withColumnRenamed("importance_mean", "coefficient"))


@query("h20_coefficient_stability", f"""WITH {d.PRED}, imp AS ({IMPORTANCE}), g AS (SELECT feature, avg(importance_mean) AS mean_coefficient, stddev_samp(importance_mean) AS std_coefficient,
  avg(abs(importance_mean)) AS mean_absolute_coefficient, stddev_samp(abs(importance_mean)) AS std_absolute_coefficient, count(*) FILTER (importance_mean > 0) AS positive_splits,
  count(*) FILTER (importance_mean < 0) AS negative_splits, count(*) FILTER (abs(importance_mean) <= 1e-8) AS zero_splits, count(*) AS split_count FROM imp GROUP BY feature),
 k AS (SELECT *, greatest(positive_splits, negative_splits, zero_splits) / split_count AS direction_consistency FROM g)
SELECT *, CASE WHEN direction_consistency >= 0.9 THEN 'stable' WHEN direction_consistency < 0.7 THEN 'unstable' ELSE 'mixed' END AS stability FROM k""",
       doubles="mean_coefficient std_coefficient mean_absolute_coefficient std_absolute_coefficient direction_consistency", longs="positive_splits negative_splits zero_splits split_count")
def h20(spark: Spark, sf: str) -> DataFrame:
    c = _importance(spark, sf).select("split", "feature", F.col("importance_mean").alias("coefficient_mean"),
                                      F.abs("importance_mean").alias("coefficient_abs_mean"))
    return importance.coefficient_stability(c)


@query("h21_selection_frequency", f"""WITH {d.PRED}, imp AS ({IMPORTANCE}), {SELECTED}, n AS (SELECT k AS subset_size, split, feature FROM w, (VALUES (1), (2), (3)) AS v(k) WHERE rank <= k)
SELECT subset_size, feature, count(*) AS times, count(*) / (SELECT count(DISTINCT split) FROM imp) AS selection_frequency FROM n GROUP BY subset_size, feature""",
       doubles="selection_frequency", longs="subset_size times")
def h21(spark: Spark, sf: str) -> DataFrame:
    from pyspark.sql import Window
    w = Window.partitionBy("split").orderBy(F.desc("importance_mean"), "feature")
    r = _importance(spark, sf).withColumn("rank", F.row_number().over(w)).withColumn(
        "subset_size", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).filter("rank <= subset_size")
    lists = r.groupBy("split", "subset_size").agg(F.concat_ws("|", F.sort_array(F.collect_list("feature"))).alias("features"))
    return importance.selection_frequency(lists)


@query("a17_importance_concentration", f"""WITH {d.PRED}, imp AS ({IMPORTANCE}), m AS (SELECT feature, avg(importance_mean) AS i FROM imp GROUP BY feature),
 r AS (SELECT *, row_number() OVER (ORDER BY i DESC, feature) AS k FROM m)
SELECT sum(greatest(i, 0)) FILTER (k <= 1) / sum(greatest(i, 0)) AS top_1_share, sum(greatest(i, 0)) FILTER (k <= 2) / sum(greatest(i, 0)) AS top_2_share FROM r""",
       doubles="top_1_share top_2_share")
def a17b(spark: Spark, sf: str) -> DataFrame:
    m = _importance(spark, sf).groupBy("feature").agg(F.avg("importance_mean").alias("importance"))
    return profile.importance_concentration(m, (1, 2))


# --- C4 and rules -----------------------------------------------------------------------------------

@query("c4_choose_calibration", f"""WITH {d.METHODS}, {COMPARISON}, basis AS (SELECT * FROM comparison WHERE method = 'base'),
 chosen AS (SELECT * FROM comparison WHERE method <> 'base' ORDER BY brier_score + log_loss, method LIMIT 1),
 j AS (SELECT c.method AS selected_method, b.brier_score - c.brier_score AS brier_score_improvement, b.log_loss - c.log_loss AS log_loss_improvement,
   b.expected_calibration_error - c.expected_calibration_error AS expected_calibration_error_improvement, c.roc_auc - b.roc_auc AS roc_auc_change FROM basis b, chosen c)
SELECT *, roc_auc_change >= -0.02 AS ranking_preserved, CASE WHEN brier_score_improvement > 0 AND log_loss_improvement > 0 AND expected_calibration_error_improvement > 0 THEN 'CALIBRATION IMPROVEMENT SUPPORTED'
  WHEN brier_score_improvement > 0 OR log_loss_improvement > 0 THEN 'CALIBRATION IMPROVEMENT PARTIAL' ELSE 'CALIBRATION IMPROVEMENT NOT SUPPORTED' END AS status FROM j""",
       doubles="brier_score_improvement log_loss_improvement expected_calibration_error_improvement roc_auc_change")
def c4(spark: Spark, sf: str) -> DataFrame:
    return calibrate.choose_calibration(_comparison(spark, sf), "base", ["sigmoid", "isotonic"])


RULES = [
    ("precision", "lt", 0.40, "Fewer than 40 percent of the flags are right."),
    ("predicted_positive_percent", "gt", 50.0, "Most rows are flagged."),
    ("recall", "ge", 0.70, "Detection comes first here."),
    ("specificity", "lt", 0.60, "Many negatives are flagged."),
    ("roc_auc", "between", (0.60, 0.70), "Ranking quality is moderate."),
    ("expected_calibration_error", "ge", 0.10, "Probabilities are poorly calibrated."),
]
RULE_METRICS = ["precision", "predicted_positive_percent", "recall", "specificity", "roc_auc", "expected_calibration_error", "brier_score", "log_loss", "flagged_per_1000"]
LONG = "long AS (" + " UNION ALL ".join(f"SELECT method, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM comparison" for m in RULE_METRICS) + ")"
RULE_SQL = "rules(priority, metric, op, bound, upper, message) AS (VALUES " + ", ".join(
    f"({i + 1}, '{m}', '{op}', CAST({b[0] if isinstance(b, tuple) else b} AS DOUBLE), CAST({b[1] if isinstance(b, tuple) else 0} AS DOUBLE), '{msg}')"
    for i, (m, op, b, msg) in enumerate(RULES)) + """),
 hits AS (SELECT method, priority, metric, value, message FROM long JOIN rules USING (metric)
   WHERE CASE op WHEN 'lt' THEN value < bound WHEN 'gt' THEN value > bound WHEN 'ge' THEN value >= bound ELSE value >= bound AND value < upper END)"""


def _long(spark: Spark, sf: str) -> DataFrame:
    return rules.metrics_long(_comparison(spark, sf), RULE_METRICS, ["method"])


@query("r1_flags", f"WITH {d.METHODS}, {COMPARISON}, {LONG}, {RULE_SQL} SELECT * FROM hits", doubles="value", longs="priority")
def r1(spark: Spark, sf: str) -> DataFrame:
    return rules.flags(_long(spark, sf), RULES, ["method"])


@query("r1_diagnosis", f"""WITH {d.METHODS}, {COMPARISON}, {LONG}, {RULE_SQL}
SELECT c.method, coalesce(first(message ORDER BY priority) FILTER (message IS NOT NULL), 'No concerns.') AS diagnosis, count(message) AS rules_met
FROM comparison c LEFT JOIN hits h ON c.method = h.method GROUP BY c.method""", longs="rules_met")
def r1b(spark: Spark, sf: str) -> DataFrame:
    return rules.diagnosis(_long(spark, sf), RULES, "No concerns.", ["method"])


LIMITS = [("brier_below_0_20", "brier_score", "lt", 0.20, True), ("log_loss_below_0_55", "log_loss", "lt", 0.55, True),
          ("ece_below_0_10", "expected_calibration_error", "lt", 0.10, True),
          ("precision_at_least_0_40", "precision", "ge", 0.40, False), ("flagged_at_most_400", "flagged_per_1000", "le", 400, False)]
CHECKS = "lim(name, metric, op, bound, blocking) AS (VALUES " + ", ".join(
    f"('{n}', '{m}', '{op}', CAST({b} AS DOUBLE), {str(k).upper()})" for n, m, op, b, k in LIMITS) + """),
 checks AS (SELECT method, name, value, CASE op WHEN 'lt' THEN value < bound WHEN 'ge' THEN value >= bound ELSE value <= bound END AS passed, blocking FROM lim JOIN long USING (metric))"""


@query("r2_gate", f"""WITH {d.METHODS}, {COMPARISON}, {LONG}, {CHECKS}
SELECT method, CASE WHEN count(*) FILTER (NOT passed AND blocking) > 0 THEN 'NO-GO' WHEN count(*) FILTER (NOT passed AND NOT blocking) > 0 THEN 'CONDITIONAL GO' ELSE 'GO' END AS status,
  count(*) AS checks, count(*) FILTER (passed) AS passed_checks, coalesce(string_agg(name, '; ' ORDER BY name) FILTER (NOT passed AND blocking), '') AS blocking_failures,
  coalesce(string_agg(name, '; ' ORDER BY name) FILTER (NOT passed AND NOT blocking), '') AS conditions FROM checks GROUP BY method""", longs="checks passed_checks")
def r2(spark: Spark, sf: str) -> DataFrame:
    return rules.gate(rules.metric_checks(_long(spark, sf), LIMITS, ["method"]), ["method"])


EXPECTED = [("calibration", "brier_score", 0.1731, 0.03), ("calibration", "expected_calibration_error", 0.0314, 0.02),
            ("operating point", "precision", 0.3416, 0.03), ("operating point", "flagged_per_1000", 401.6, 20.0), ("ranking", "absent_metric", 0.5, 0.1)]


@query("r3_evidence_table", f"""WITH {d.METHODS}, {COMPARISON}, {LONG}, e(category, metric, expected, tolerance) AS (VALUES {', '.join(f"('{c}', '{m}', CAST({v} AS DOUBLE), CAST({t} AS DOUBLE))" for c, m, v, t in EXPECTED)})
SELECT category, e.metric, value, expected, tolerance, CASE WHEN abs(value - expected) <= tolerance THEN 'PASS' ELSE 'FAIL' END AS status
FROM e LEFT JOIN (SELECT * FROM long WHERE method = 'sigmoid') AS l ON e.metric = l.metric""", doubles="value expected tolerance")
def r3(spark: Spark, sf: str) -> DataFrame:
    return rules.evidence_table(_long(spark, sf).filter("method = 'sigmoid'"), EXPECTED)


@query("r3_assessment_table", f"""WITH {d.METHODS}, {COMPARISON}, {LONG}
SELECT 'quality' AS category, metric, value, CASE WHEN value >= 0.4 THEN 'acceptable' ELSE 'below target' END AS assessment, 'false positives' AS impact FROM long WHERE metric = 'precision' AND method = 'base'""",
       doubles="value")
def r3b(spark: Spark, sf: str) -> DataFrame:
    return rules.assessment_table(_long(spark, sf).filter("method = 'base'"),
                                  [("quality", "precision", 0.4, "acceptable", "below target", "false positives")])


@query("r4_availability_checks", f"""WITH {d.METHODS}, have AS (SELECT method AS name, count(*) AS n FROM preds GROUP BY method), need(name) AS (VALUES ('base'), ('sigmoid'), ('temperature'))
SELECT need.name, n IS NOT NULL AS "exists", coalesce(n > 0, FALSE) AS passed, TRUE AS blocking FROM need LEFT JOIN have ON need.name = have.name""")
def r4(spark: Spark, sf: str) -> DataFrame:
    have = d.method_predictions(spark, sf).groupBy(F.col("method").alias("name")).agg(
        F.lit(True).alias("available"), F.count(F.lit(1)).alias("rows"))
    return rules.availability_checks(["base", "sigmoid", "temperature"], have)


@query("r5_extract_metrics", f"""WITH {d.METHODS}, {COMPARISON}
SELECT 'brier_score' AS metric, (SELECT brier_score FROM comparison WHERE method = 'sigmoid') AS value
UNION ALL SELECT 'expected_calibration_error', (SELECT expected_calibration_error FROM comparison WHERE method = 'base') UNION ALL SELECT 'threshold', NULL""", doubles="value")
def r5(spark: Spark, sf: str) -> DataFrame:
    long = _long(spark, sf)
    key = F.when(F.col("metric") == "brier_score", "Brier ").when(F.col("metric") == "expected_calibration_error", "ECE").otherwise(F.col("metric"))
    report = long.filter("method = 'base'").select(key.alias("key"), F.col("value").cast("string").alias("value"))
    table = long.filter("method = 'sigmoid' AND metric = 'brier_score'").select(F.col("metric").alias("key"), F.col("value").cast("string").alias("value"))
    return rules.extract_metrics(report, table, {"brier_score": ["brier_score", "brier"], "expected_calibration_error": ["expected_calibration_error", "ece"],
                                                 "threshold": ["threshold"]})


@query("r6_validate_scores", f"""WITH {d.PRED}, s AS (SELECT p, CAST(p >= 0.25 AS INT) AS flag FROM pred),
 c AS (SELECT count(*) = count(p) AS a, count(*) FILTER (isnan(p) OR isinf(p)) = 0 AS b, count(*) FILTER (p < 0 OR p > 1) = 0 AS c, count(*) FILTER (flag <> CAST(p >= 0.3 AS INT)) = 0 AS d,
   FALSE AS e, count(*) = (SELECT count(*) FROM orders) AS f FROM s)
SELECT 'no_null_scores' AS "check", a AS passed FROM c UNION ALL SELECT 'all_finite', b FROM c UNION ALL SELECT 'within_unit_interval', c FROM c
UNION ALL SELECT 'flag_matches_threshold', d FROM c UNION ALL SELECT 'threshold_equal', e FROM c UNION ALL SELECT 'row_count_matches', f FROM c""")
def r6(spark: Spark, sf: str) -> DataFrame:
    s = d.predictions(spark, sf).select("p", (F.col("p") >= 0.25).cast("int").alias("flag"), F.lit(0.25).alias("threshold"))
    return rules.validate_scores(s, d.table(spark, sf, "orders").count(), 0.3)


# --- V: splits with a digest any engine can reproduce ------------------------------------------------

def pos_sql(seed: str) -> str:
    return f"CAST(('0x' || substr(md5({seed} || '-' || id), 1, 15)) AS BIGINT)"


@query("v1_stratified_holdout", f"""WITH {d.OC}, r AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {pos_sql("'42'")}) AS k, count(*) OVER (PARTITION BY y) AS n FROM oc)
SELECT id, y, k <= floor(n * 0.2 + 0.5) AS is_holdout FROM r""", longs="id y")
def v1(spark: Spark, sf: str) -> DataFrame:
    oc = d.orders_customers(spark, sf).select("id", "y")
    return splits.stratified_holdout(oc, "y", ["id"], 0.2, pos=splits.portable_position(["id"], 42))


@query("v2_stratified_kfold", f"""WITH {d.OC}, r AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {pos_sql("'42'")}) - 1 AS k, count(*) OVER (PARTITION BY y) AS n FROM oc)
SELECT id, y, len(list_filter([1, 2, 3, 4], lambda f: floor(n * f / 5) <= k)) AS fold FROM r""", longs="id y fold")
def v2(spark: Spark, sf: str) -> DataFrame:
    oc = d.orders_customers(spark, sf).select("id", "y")
    return splits.stratified_kfold(oc, "y", ["id"], 5, pos=splits.portable_position(["id"], 42))


@query("v3_repeated_stratified_kfold", f"""WITH {d.OC}, s AS (SELECT id, y, repeat, {pos_sql('seed')} AS pos FROM oc, (VALUES (0, 42), (1, 52), (2, 62), (3, 72), (4, 82)) AS v(repeat, seed)),
 r AS (SELECT *, row_number() OVER (PARTITION BY repeat, y ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY repeat, y) AS n FROM s),
 f AS (SELECT id, y, repeat, len(list_filter([1, 2, 3, 4], lambda f: floor(n * f / 5) <= k)) AS fold FROM r) SELECT *, repeat * 5 + fold AS split FROM f""", longs="id y repeat fold split")
def v3(spark: Spark, sf: str) -> DataFrame:
    oc = d.orders_customers(spark, sf).select("id", "y")
    return splits.repeated_stratified_kfold(oc, "y", ["id"], 5, portable=True)


@query("v4_repeated_holdout", f"""WITH {d.OC}, s AS (SELECT id, y, split, {pos_sql('(42 + split)')} AS pos FROM oc, range(50) AS v(split)),
 r AS (SELECT *, row_number() OVER (PARTITION BY split, y ORDER BY pos) AS k, count(*) OVER (PARTITION BY split, y) AS n FROM s)
SELECT split, y, count(*) AS rows, count(*) FILTER (k <= floor(n * 0.2 + 0.5)) AS holdout_rows, sum(id) FILTER (k <= floor(n * 0.2 + 0.5)) AS holdout_ids FROM r GROUP BY split, y""",
       longs="split y rows holdout_rows holdout_ids")
def v4(spark: Spark, sf: str) -> DataFrame:
    s = splits.repeated_holdout(d.orders_customers(spark, sf).select("id", "y"), "y", ["id"], 50, portable=True)
    return s.groupBy("split", "y").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_holdout").alias("holdout_rows"),
                                       F.sum(F.when(F.col("is_holdout"), F.col("id"))).alias("holdout_ids"))


@query("st14_correlation_stability", f"""WITH {d.OC}, r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {pos_sql("'42'")}) - 1 AS k, count(*) OVER (PARTITION BY y) AS n FROM oc),
 f AS (SELECT *, len(list_filter([1, 2, 3, 4], lambda f: floor(n * f / 5) <= k)) AS fold FROM r),
 c AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, v.t, corr({c}, y) AS r FROM f JOIN range(5) AS v(t) ON fold <> t GROUP BY t" for c in d.NUMS)})
SELECT feature, avg(r) AS mean_r, stddev_samp(r) AS std_r, min(r) AS min_r, max(r) AS max_r, count(*) FILTER (r > 0) AS positive_splits, count(*) FILTER (r < 0) AS negative_splits,
  greatest(count(*) FILTER (r > 0), count(*) FILTER (r < 0)) / count(*) AS direction_consistency FROM c GROUP BY feature""",
       doubles="mean_r std_r min_r max_r direction_consistency", longs="positive_splits negative_splits")
def st14(spark: Spark, sf: str) -> DataFrame:
    from plumbline.operators.stats import correlation_stability
    f = splits.stratified_kfold(d.orders_customers(spark, sf).select("id", "y", *d.NUMS), "y", ["id"], 5,
                                pos=splits.portable_position(["id"], 42))
    training = f.withColumn("split", F.explode(F.array(*[F.lit(i) for i in range(5)]))).filter("fold <> split")
    return correlation_stability(training, d.NUMS, "y", "split")


# --- M: feature preparation --------------------------------------------------------------------------

@query("m1_impute_median", f"""WITH {d.MESSY} SELECT id, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM messy)) AS price FROM messy""", doubles="price", longs="id")
def m1(spark: Spark, sf: str) -> DataFrame:
    from plumbline.operators.features import apply_fill, impute_median
    m = d.messy_orders(spark, sf).select("id", "price")
    return apply_fill(m, impute_median(m, ["price"]), ["price"])


@query("m2_impute_mode", f"""WITH {d.MESSY} SELECT id, coalesce(priority, (SELECT priority FROM messy WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)) AS priority,
  coalesce(status, (SELECT status FROM messy WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)) AS status FROM messy""", longs="id")
def m2(spark: Spark, sf: str) -> DataFrame:
    from plumbline.operators.features import apply_fill, impute_mode
    m = d.messy_orders(spark, sf).select("id", "priority", "status")
    return apply_fill(m, impute_mode(m, ["priority", "status"]), ["priority", "status"])


@query("m3_scale", f"""WITH {d.OC} SELECT id, (price - (SELECT avg(price) FROM oc)) / (SELECT stddev_pop(price) FROM oc) AS price,
  (balance - (SELECT avg(balance) FROM oc)) / (SELECT stddev_pop(balance) FROM oc) AS balance FROM oc""", doubles="price balance", longs="id", digits=5)
def m3(spark: Spark, sf: str) -> DataFrame:
    from plumbline.operators.features import scale, scale_stats
    oc = d.orders_customers(spark, sf).select("id", *d.NUMS)
    return scale(oc, scale_stats(oc, d.NUMS), d.NUMS)
