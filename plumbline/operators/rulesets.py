"""Ready rule sets for :mod:`plumbline.operators.rules`.

Rules are ``(metric, op, bound, message)`` in order of priority. Bounds are fixed
values; metrics carry the names the operators give them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import attach_scalars, ratio

# Bounds of the signal checks.
SIGNAL = [
    ("max_abs_r", "lt", 0.05, "numeric features are almost unrelated to the target"),
    ("max_abs_r", "between", (0.05, 0.10), "numeric features are weakly related to the target"),
    ("max_abs_r", "ge", 0.10, "some numeric feature is related to the target"),
    ("max_cramers_v", "lt", 0.05, "categories are almost unrelated to the target"),
    ("max_cramers_v", "between", (0.05, 0.10), "categories are modestly related to the target"),
    ("max_cramers_v", "ge", 0.10, "some category is related to the target"),
    ("max_interaction_range", "ge", 0.20, "some feature pairs separate the rates strongly"),
    ("max_interaction_range", "between", (0.10, 0.20), "some feature pairs separate the rates moderately"),
    ("max_interaction_range", "lt", 0.10, "feature pairs do not separate the rates"),
    ("positive_rate", "lt", 0.10, "positives are rare"),
    ("positive_rate", "between", (0.10, 0.20), "classes are moderately unbalanced"),
    ("positive_rate", "gt", 0.40, "positives are unusually frequent"),
    ("entropy_bits", "lt", 0.50, "the target carries little entropy"),
]

# Bounds of the data checks, against an expected prevalence.
DATA = [
    ("prevalence_delta_pp", "ge", 3.0, "prevalence is far from the expected one: check version, target rule and filters"),
    ("prevalence_delta_pp", "between", (1.0, 3.0), "prevalence differs from the expected one"),
    ("duplicates_all_members", "gt", 0.0, "rows take part in exact duplicate groups"),
    ("rows_with_any_missing", "gt", 0.0, "rows have missing values; keeping complete rows changes the data"),
    ("constant_columns", "gt", 0.0, "constant columns found"),
    ("filter_prevalence_shift_pp", "ge", 1.0, "a cleaning filter shifts the prevalence"),
]

# Bounds of the checks between training and hold-out data.
DRIFT = [
    ("target_difference_pp", "ge", 5.0, "target rates differ strongly between the sides"),
    ("target_difference_pp", "between", (2.0, 5.0), "target rates differ between the sides"),
    ("max_ks_statistic", "ge", 0.20, "strong drift in numbers"),
    ("max_ks_statistic", "between", (0.10, 0.20), "some drift in numbers"),
    ("max_total_variation", "ge", 0.20, "strong drift in categories"),
    ("max_total_variation", "between", (0.10, 0.20), "some drift in categories"),
    ("gap_roc_auc", "lt", -0.05, "ranking is worse on the hold-out"),
    ("gap_pr_auc", "lt", -0.05, "precision-recall is worse on the hold-out"),
    ("brier_score", "gt", 0.20, "probabilities may be poorly calibrated"),
]

# Bounds of the checks of a chosen threshold against 0.5.
THRESHOLD = [
    ("threshold", "lt", 0.40, "the threshold is far below 0.5 and favours recall"),
    ("threshold", "between", (0.40, 0.60), "the threshold is near 0.5"),
    ("threshold", "gt", 0.60, "the threshold is far above 0.5 and favours precision"),
    ("f1_gain", "gt", 0.02, "F1 gains clearly over 0.5"),
    ("f1_gain", "between", (1e-9, 0.02), "F1 gains a little over 0.5"),
    ("f1_gain", "lt", 1e-9, "F1 does not gain over 0.5"),
    ("predicted_positive_rate", "gt", 0.50, "more than half of all rows are flagged"),
    ("flagged_to_prevalence", "gt", 2.0, "flags exceed twice the prevalence"),
]

# Bounds of the last validation of a model over its splits.
VALIDATION = [
    ("roc_auc", "lt", 0.60, "weak ranking"),
    ("roc_auc", "between", (0.60, 0.70), "modest ranking"),
    ("roc_auc", "ge", 0.70, "strong ranking"),
    ("roc_auc_std", "ge", 0.05, "ranking depends on the split"),
    ("roc_auc_std", "lt", 0.05, "ranking is steady over the splits"),
    ("precision", "lt", 0.40, "most flags are false"),
]

# Findings that need several metrics at once.
TRADE_OFFS = [
    ([("f1_gain", "gt", 0.0), ("predicted_positive_rate", "gt", 0.50)], "F1 gains, but by flagging more than half of all rows"),
    ([("precision", "lt", 0.40), ("recall", "gt", 0.70)], "recall is bought with many false flags"),
    ([("roc_auc", "ge", 0.60), ("roc_auc_std", "lt", 0.05), ("f1_gain", "ge", 0.0)], "ranking holds over the splits and the threshold pays"),
]

# Bounds of the checks of one operating point and its probabilities.
OPERATING_POINT = [
    ("calibration_bias", "ge", 0.10, "scores are too high on average"),
    ("expected_calibration_error", "ge", 0.10, "calibration error is at least 0.10"),
    ("brier_score", "ge", 0.25, "Brier score is no better than a constant guess"),
    ("predicted_positive_percent", "gt", 50.0, "more than half of all rows are flagged"),
    ("flagged_to_prevalence", "gt", 2.0, "flags exceed twice the prevalence"),
    ("precision", "lt", 0.40, "precision is below 0.40"),
    ("recall", "ge", 0.70, "at least 70 % of positives are found"),
    ("specificity", "lt", 0.60, "specificity is below 0.60"),
    ("roc_auc", "lt", 0.60, "ranking is weak"),
]

# Production gates; the last flag marks checks that block.
PRODUCTION_GATE = [
    ("brier_below_0_20", "brier_score", "lt", 0.20, True),
    ("log_loss_below_0_55", "log_loss", "lt", 0.55, True),
    ("ece_below_0_10", "expected_calibration_error", "lt", 0.10, True),
    ("precision_at_least_0_40", "precision", "ge", 0.40, False),
    ("recall_at_least_0_70", "recall", "ge", 0.70, False),
    ("flagged_at_most_400", "flagged_per_1000", "le", 400.0, False),
]


def signal_metrics(concentration: DataFrame, interactions: DataFrame, target: DataFrame,
                   entropy: DataFrame) -> DataFrame:
    """One row with every metric the signal rules use, from the operators' results."""
    spread = interactions.agg(F.max("rate_range").alias("max_interaction_range"))
    out = attach_scalars(concentration.select("max_abs_r", "max_cramers_v"), spread)
    out = attach_scalars(out, target.select("positive_rate"))
    return attach_scalars(out, entropy.select("entropy_bits"))


def drift_metrics(target: DataFrame, ks: DataFrame, categories: DataFrame) -> DataFrame:
    """One row with the drift metrics: target change, largest numeric and categorical drift."""
    out = target.select(F.abs("difference_pp").alias("target_difference_pp"))
    out = attach_scalars(out, ks.agg(F.max("ks_statistic").alias("max_ks_statistic")))
    return attach_scalars(out, categories.agg(F.max("total_variation_distance").alias("max_total_variation")))


def data_metrics(target: DataFrame, duplicates: DataFrame, missing: DataFrame, variance: DataFrame,
                 filters: DataFrame) -> DataFrame:
    """One row with the data-quality metrics from the audits."""
    out = target.select(F.abs("delta_pp").alias("prevalence_delta_pp"))
    out = attach_scalars(out, duplicates.select("duplicates_all_members"))
    out = attach_scalars(out, missing.select("rows_with_any_missing"))
    out = attach_scalars(out, variance.agg(F.count_if("constant").alias("constant_columns")))
    original = F.max(F.when(F.col("operation") == "original", F.col("prevalence_percent")))
    shift = F.greatest(F.abs(F.max("prevalence_percent") - original), F.abs(F.min("prevalence_percent") - original))
    return attach_scalars(out, filters.agg(shift.alias("filter_prevalence_shift_pp")))


def operating_metrics(comparison: DataFrame) -> DataFrame:
    """A model comparison with the flagged share relative to the observed rate."""
    return comparison.withColumn("flagged_to_prevalence", ratio(F.col("predicted_positive_rate"), F.col("observed_rate")))
