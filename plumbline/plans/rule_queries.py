"""The ready rule sets over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import contract, metrics, profile, rules, rulesets, stats
from plumbline.plans import datasets as d
from plumbline.plans.metric_queries import COMPARISON, THRESHOLDS
from plumbline.plans.profile_queries import LEVELS, PAIRS, stack
from plumbline.plans.registry import query
from plumbline.plans.stats_queries import KS, chi_sql

Spark = SparkSession
_TESTS = {"lt": "value < bound", "le": "value <= bound", "gt": "value > bound", "ge": "value >= bound",
          "between": "value >= bound AND value < upper"}


def hits_sql(rule_set: list[tuple], wide: str, keys: str = "") -> str:
    """Flags of a rule set over a CTE with one column per metric."""
    names = list(dict.fromkeys(m for m, *_ in rule_set))
    by = f"{keys}, " if keys else ""
    long = " UNION ALL ".join(f"SELECT {by}'{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {wide}" for m in names)
    table = ", ".join(f"({i + 1}, '{m}', '{op}', CAST({b[0] if isinstance(b, tuple) else b} AS DOUBLE), "
                      f"CAST({b[1] if isinstance(b, tuple) else 0} AS DOUBLE), '{msg}')" for i, (m, op, b, msg) in enumerate(rule_set))
    test = " ".join(f"WHEN '{op}' THEN {t}" for op, t in _TESTS.items())
    return f"""SELECT {by}priority, l.metric, value, message FROM ({long}) AS l
  JOIN (VALUES {table}) AS r(priority, metric, op, bound, upper, message) ON l.metric = r.metric WHERE CASE op {test} END"""


def _flags(wide: DataFrame, rule_set: list[tuple], keys: tuple[str, ...] = ()) -> DataFrame:
    names = list(dict.fromkeys(m for m, *_ in rule_set))
    return rules.flags(rules.metrics_long(wide, names, keys), rule_set, keys)


@query("r1_signal_flags", f"""WITH {d.OC}, {LEVELS}, v AS (WITH {chi_sql('oc', 'y', False, False, *d.CATS)}),
 w AS (SELECT (SELECT max(r) FROM ({stack('SELECT abs(corr({c}, y)) AS r FROM oc', *d.NUMS)}) AS x) AS max_abs_r, (SELECT max(cramers_v) FROM v) AS max_cramers_v,
  (SELECT max(hi - lo) FROM (SELECT max(rate) AS hi, min(rate) AS lo FROM inter GROUP BY feature_a, feature_b) AS x) AS max_interaction_range,
  (SELECT avg(y) FROM oc) AS positive_rate,
  (SELECT sum(-s * log2(s)) FROM (SELECT count(*) / (SELECT count(*) FROM oc) AS s FROM oc GROUP BY y) AS x) AS entropy_bits)
{hits_sql(rulesets.SIGNAL, 'w')}""", doubles="value", longs="priority")
def signal(spark: Spark, sf: str) -> DataFrame:
    oc = d.orders_customers(spark, sf)
    v = stats.chi_square_cramers_v(oc, d.CATS, "y", yates=False, bias_correction=False).select("feature", "cramers_v")
    dev = stats.effect_strength(oc, d.CATS, "y").select("feature", F.col("max_rate_deviation").alias("max_deviation"))
    wide = rulesets.signal_metrics(
        profile.signal_concentration(stats.point_biserial(oc, d.NUMS, "y"), v.join(dev, "feature")),
        profile.interaction_range(profile.interaction_rates(oc, PAIRS, "y")),
        profile.target_summary(oc, "y", "1", "0"), profile.target_entropy(oc, "y"))
    return _flags(wide, rulesets.SIGNAL)


TV = " UNION ALL ".join(
    f"SELECT sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0))) / 2 AS tv FROM (SELECT {c} AS value, count(*) / (SELECT count(*) FROM early) AS s FROM early GROUP BY 1) AS a "
    f"FULL OUTER JOIN (SELECT {c} AS value, count(*) / (SELECT count(*) FROM late) AS s FROM late GROUP BY 1) AS b ON a.value = b.value" for c in d.CATS)


@query("r1_drift_metrics", f"""WITH {d.SIDES}, {KS}
SELECT abs((SELECT avg(y) FROM late) - (SELECT avg(y) FROM early)) * 100 AS target_difference_pp, (SELECT max(ks_statistic) FROM ks) AS max_ks_statistic,
  (SELECT max(tv) FROM ({TV}) AS t) AS max_total_variation""", doubles="target_difference_pp max_ks_statistic max_total_variation")
def drift(spark: Spark, sf: str) -> DataFrame:
    a, b = d.early_late(spark, sf)
    return rulesets.drift_metrics(stats.target_drift(a, b, "y"), stats.ks_two_sample(a, b, d.NUMS),
                                  stats.categorical_drift(a, b, d.CATS))


@query("r1_data_flags", f"""WITH {d.MESSY}, m AS (SELECT * REPLACE (CASE status WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' END AS status) FROM messy),
 dd AS (SELECT id, price, balance, priority, segment, status, count(*) AS n FROM m GROUP BY ALL),
 p AS (SELECT 100.0 * count(*) FILTER (status = 'yes') / count(status) AS v FROM m UNION ALL SELECT 100.0 * count(*) FILTER (status = 'yes') / count(status) FROM m
   WHERE price IS NOT NULL AND priority IS NOT NULL AND status IS NOT NULL UNION ALL SELECT 100.0 * count(*) FILTER (status = 'yes') / count(status) FROM dd),
 o AS (SELECT 100.0 * count(*) FILTER (status = 'yes') / count(status) AS v FROM m),
 w AS (SELECT abs((SELECT count(*) FILTER (status = 'yes') / count(*) FROM m) - 0.3) * 100 AS prevalence_delta_pp, (SELECT sum(n) FILTER (n > 1) FROM dd) AS duplicates_all_members,
   (SELECT count(*) FROM m WHERE price IS NULL OR priority IS NULL OR status IS NULL) AS rows_with_any_missing, 0 AS constant_columns,
   (SELECT max(abs(p.v - o.v)) FROM p, o) AS filter_prevalence_shift_pp)
{hits_sql(rulesets.DATA, 'w')}""", doubles="value", longs="priority")
def data(spark: Spark, sf: str) -> DataFrame:
    m = d.messy_orders(spark, sf).withColumn("status", F.when(F.col("status") == "F", "yes").when(F.col("status") == "O", "no"))
    wide = rulesets.data_metrics(profile.target_summary(m, "status", "yes", "no", 0.3), profile.duplicate_audit(m),
                                 profile.missing_rows(m), profile.variance_audit(m, d.CATS), contract.filter_impact(m, "status"))
    return _flags(wide, rulesets.DATA)


@query("r1_operating_flags", f"""WITH {d.METHODS}, {COMPARISON}, w AS (SELECT *, predicted_positive_rate / observed_rate AS flagged_to_prevalence FROM comparison)
{hits_sql(rulesets.OPERATING_POINT, 'w', 'method')}""", doubles="value", longs="priority")
def operating(spark: Spark, sf: str) -> DataFrame:
    wide = rulesets.operating_metrics(metrics.model_comparison(d.method_predictions(spark, sf), THRESHOLDS))
    return _flags(wide, rulesets.OPERATING_POINT, ("method",))


_OPS = {"lt": "<", "le": "<=", "ge": ">="}
GATE_ROWS = " UNION ALL ".join(
    f"SELECT method, '{n}' AS name, {m} {_OPS[op]} {b} AS passed, {str(k).upper()} AS blocking FROM comparison"
    for n, m, op, b, k in rulesets.PRODUCTION_GATE)


@query("r2_production_gate", f"""WITH {d.METHODS}, {COMPARISON}, gate_rows AS ({GATE_ROWS})
SELECT method, CASE WHEN count(*) FILTER (NOT passed AND blocking) > 0 THEN 'NO-GO' WHEN count(*) FILTER (NOT passed) > 0 THEN 'CONDITIONAL GO' ELSE 'GO' END AS status,
  count(*) AS checks, count(*) FILTER (passed) AS passed_checks, coalesce(string_agg(name, '; ' ORDER BY name) FILTER (NOT passed AND blocking), '') AS blocking_failures,
  coalesce(string_agg(name, '; ' ORDER BY name) FILTER (NOT passed AND NOT blocking), '') AS conditions FROM gate_rows GROUP BY method""",
       longs="checks passed_checks")
def production(spark: Spark, sf: str) -> DataFrame:
    wide = metrics.model_comparison(d.method_predictions(spark, sf), THRESHOLDS)
    long = rules.metrics_long(wide, list(dict.fromkeys(m for _, m, *_ in rulesets.PRODUCTION_GATE)), ["method"])
    return rules.gate(rules.metric_checks(long, rulesets.PRODUCTION_GATE, ["method"]), ["method"])


def _at(t: float) -> str:
    return f"""count(*) FILTER (p >= {t} AND y = 1) AS tp, count(*) FILTER (p >= {t} AND y = 0) AS fp, count(*) FILTER (p < {t} AND y = 1) AS fn"""


VALIDATED = d.PRED + f""", chosen AS (SELECT segment, {_at(0.44)}, count(*) AS n, sum(y) AS pos FROM pred GROUP BY segment),
 usual AS (SELECT segment, {_at(0.5)} FROM pred GROUP BY segment),
 won AS (SELECT segment, split, sum(y * (neg_before + neg / 2.0)) / (sum(y) * sum(neg)) AS roc_auc FROM (
   SELECT segment, split, sum(y) AS y, sum(1 - y) AS neg, sum(sum(1 - y)) OVER (PARTITION BY segment, split ORDER BY p) - sum(1 - y) AS neg_before
   FROM pred GROUP BY segment, split, p) GROUP BY segment, split),
 spread AS (SELECT segment, avg(roc_auc) AS roc_auc, stddev_samp(roc_auc) AS roc_auc_std FROM won GROUP BY segment),
 wide AS (SELECT segment, 0.44 AS threshold, 2.0 * c.tp / (2 * c.tp + c.fp + c.fn) - 2.0 * u.tp / (2 * u.tp + u.fp + u.fn) AS f1_gain,
   (c.tp + c.fp)::DOUBLE / n AS predicted_positive_rate, (c.tp + c.fp)::DOUBLE / pos AS flagged_to_prevalence,
   c.tp::DOUBLE / (c.tp + c.fp) AS "precision", c.tp::DOUBLE / (c.tp + c.fn) AS recall, roc_auc, roc_auc_std
   FROM chosen c JOIN usual u USING (segment) JOIN spread USING (segment))"""


def _validated(spark: Spark, sf: str) -> DataFrame:
    """Per segment the metrics of the threshold 0.44, its gain over 0.5 and the ranking over the splits."""
    pred = d.predictions(spark, sf)
    at = metrics.threshold_metrics(pred, 0.44, ["segment"])
    usual = metrics.threshold_metrics(pred, 0.5, ["segment"]).select("segment", F.col("f1").alias("usual"))
    spread = metrics.ranking_metrics(pred, ["segment", "split"]).groupBy("segment").agg(
        F.avg("roc_auc").alias("roc_auc"), F.stddev_samp("roc_auc").alias("roc_auc_std"))
    prevalence = pred.groupBy("segment").agg(F.avg("y").alias("prevalence"))
    return at.join(usual, "segment").join(spread, "segment").join(prevalence, "segment").select(
        "segment", "threshold", (F.col("f1") - F.col("usual")).alias("f1_gain"), "predicted_positive_rate",
        (F.col("predicted_positive_rate") / F.col("prevalence")).alias("flagged_to_prevalence"), "precision", "recall", "roc_auc", "roc_auc_std")


@query("r1_threshold_flags", f"WITH {VALIDATED} {hits_sql(rulesets.THRESHOLD, 'wide', 'segment')}", doubles="value", longs="priority")
def r1_threshold(spark: Spark, sf: str) -> DataFrame:
    return _flags(_validated(spark, sf), rulesets.THRESHOLD, ("segment",))


@query("r1_validation_flags", f"WITH {VALIDATED} {hits_sql(rulesets.VALIDATION, 'wide', 'segment')}", doubles="value", longs="priority")
def r1_validation(spark: Spark, sf: str) -> DataFrame:
    return _flags(_validated(spark, sf), rulesets.VALIDATION, ("segment",))


_OPS = {"lt": "<", "le": "<=", "gt": ">", "ge": ">="}


@query("r1_compound_flags", f"WITH {VALIDATED} " + " UNION ALL ".join(
    f"""SELECT segment, {i + 1} AS priority, '{"|".join(m for m, *_ in rule)}' AS metrics, '{message}' AS message FROM wide
    WHERE {" AND ".join(f'"{m}" {_OPS[op]} {b}' for m, op, b in rule)}""" for i, (rule, message) in enumerate(rulesets.TRADE_OFFS)), longs="priority")
def r1_compound(spark: Spark, sf: str) -> DataFrame:
    names = list(dict.fromkeys(m for rule, _ in rulesets.TRADE_OFFS for m, *_ in rule))
    return rules.compound_flags(rules.metrics_long(_validated(spark, sf), names, ("segment",)), rulesets.TRADE_OFFS, ("segment",))


@query("r6_feature_contract", f"""WITH {d.PRED}, k AS (SELECT count(price) AS a, count(balance) AS b, count(segment) AS c, count(*) AS n FROM pred)
SELECT 'contract_is_distinct' AS "check", TRUE AS passed, '' AS detail UNION ALL SELECT 'metadata_features_match', FALSE, 'priority'
UNION ALL SELECT 'model_features_match', TRUE, '' UNION ALL SELECT 'table_has_features', FALSE, 'tenure'
UNION ALL SELECT 'features_have_values', a > 0 AND b > 0 AND c > 0, '' FROM k UNION ALL SELECT 'table_has_rows', n > 0, '' FROM k""")
def r6_contract(spark: Spark, sf: str) -> DataFrame:
    """A contract with a feature that the table lacks, and metadata that name one more."""
    contract_features = ["price", "balance", "segment", "tenure"]
    return rules.feature_contract(contract_features, d.predictions(spark, sf), [*contract_features, "priority"], contract_features)
