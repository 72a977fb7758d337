"""Feature-target statistics, drift and version comparison on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import compare, stats
from plumbline.plans import datasets as d
from plumbline.plans.profile_queries import binned_sql, stack
from plumbline.plans.registry import query

Spark = SparkSession


@query("st1_point_biserial", f"WITH {d.LINES} " + stack("""
SELECT '{c}' AS feature, count({c}) AS n, avg({c}) FILTER (y = 0) AS mean_0, avg({c}) FILTER (y = 1) AS mean_1,
  avg({c}) FILTER (y = 1) - avg({c}) FILTER (y = 0) AS mean_difference, corr({c}, y) AS r, abs(corr({c}, y)) AS abs_r FROM li""", *d.LINE_NUMS),
       doubles="mean_0 mean_1 mean_difference r abs_r", longs="n")
def st1(spark: Spark, sf: str) -> DataFrame:
    return stats.point_biserial(d.line_items(spark, sf), d.LINE_NUMS, "y").drop("p_value")


@query("st1_point_biserial_pvalues")
def st1b(spark: Spark, sf: str) -> DataFrame:
    return stats.point_biserial(d.predictions(spark, sf), ["price", "balance", "p"], "y")


RANKED = "long AS (" + stack("SELECT '{c}' AS feature, y, CAST({c} AS DOUBLE) AS value FROM li", *d.LINE_NUMS) + """),
 ranked AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk,
   count(*) OVER (PARTITION BY feature, value) AS ties FROM long)"""


@query("st2_spearman", f"WITH {d.LINES}, {RANKED} SELECT feature, count(*) AS n, corr(rk, y) AS spearman, abs(corr(rk, y)) AS abs_spearman FROM ranked GROUP BY feature",
       doubles="spearman abs_spearman", longs="n")
def st2(spark: Spark, sf: str) -> DataFrame:
    return stats.spearman(d.line_items(spark, sf), d.LINE_NUMS, "y")


@query("st3_standardized_mean_diff", f"WITH {d.LINES}, m AS (" + stack("""
SELECT '{c}' AS feature, avg({c}) FILTER (y = 0) AS mean_0, avg({c}) FILTER (y = 1) AS mean_1,
  sqrt(((count(*) FILTER (y = 0) - 1) * var_samp({c}) FILTER (y = 0) + (count(*) FILTER (y = 1) - 1) * var_samp({c}) FILTER (y = 1)) / (count(*) - 2)) AS pooled_std
FROM li""", *d.LINE_NUMS) + ") SELECT *, (mean_1 - mean_0) / pooled_std AS smd FROM m", doubles="mean_0 mean_1 pooled_std smd")
def st3(spark: Spark, sf: str) -> DataFrame:
    return stats.standardized_mean_diff(d.line_items(spark, sf), d.LINE_NUMS, "y")


@query("st4_mann_whitney", f"""WITH {d.LINES}, {RANKED}
SELECT feature, count(*) FILTER (y = 0) AS n_0, count(*) FILTER (y = 1) AS n_1,
  sum(rk) FILTER (y = 0) - (count(*) FILTER (y = 0)) * (count(*) FILTER (y = 0) + 1) / 2.0 AS u_statistic FROM ranked GROUP BY feature""",
       doubles="u_statistic", longs="n_0 n_1")
def st4(spark: Spark, sf: str) -> DataFrame:
    return stats.mann_whitney(d.line_items(spark, sf), d.LINE_NUMS, "y").drop("p_value")


def chi_sql(src: str, target: str, yates: bool, corrected: bool, *cats: str) -> str:
    """Chi-square and V from the full grid of categories and classes."""
    cells = stack(f"SELECT '{{c}}' AS feature, {{c}} AS value, CAST({target} AS VARCHAR) AS cls FROM {src} WHERE {{c}} IS NOT NULL AND {target} IS NOT NULL", *cats)
    shift = "CASE WHEN nr = 2 AND nc = 2 THEN least(0.5, abs(o - e)) ELSE 0 END" if yates else "0"
    phi = "greatest(0, chi2 / n - (nc - 1) * (nr - 1) / (n - 1))" if corrected else "chi2 / n"
    room = ("least(nr - power(nr - 1, 2) / (n - 1), nc - power(nc - 1, 2) / (n - 1)) - 1" if corrected else "least(nr, nc) - 1")
    return f"""cells AS ({cells}), rt AS (SELECT feature, value, count(*) AS r FROM cells GROUP BY 1, 2), ct AS (SELECT feature, cls, count(*) AS c FROM cells GROUP BY 1, 2),
 ot AS (SELECT feature, value, cls, count(*) AS o FROM cells GROUP BY 1, 2, 3), nt AS (SELECT feature, sum(r) AS n, count(*) AS nr FROM rt GROUP BY 1), kt AS (SELECT feature, count(*) AS nc FROM ct GROUP BY 1),
 full_grid AS (SELECT rt.feature, coalesce(o, 0) AS o, CAST(r AS DOUBLE) * c / n AS e, n, nr, nc FROM rt JOIN ct ON rt.feature = ct.feature JOIN nt ON nt.feature = rt.feature JOIN kt ON kt.feature = rt.feature
   LEFT JOIN ot ON ot.feature = rt.feature AND ot.value = rt.value AND ot.cls = ct.cls),
 chi AS (SELECT feature, any_value(n) AS n, any_value(nr) AS nr, any_value(nc) AS nc, sum(power(abs(o - e) - {shift}, 2) / e) AS chi2 FROM full_grid GROUP BY feature)
SELECT feature, n, chi2, (nr - 1) * (nc - 1) AS dof, sqrt({phi} / ({room})) AS cramers_v FROM chi"""


@query("st5_chi_square", f"WITH {d.LINES}, {chi_sql('li', 'y', True, True, *d.LINE_CATS)}", doubles="chi2 cramers_v", longs="n dof")
def st5(spark: Spark, sf: str) -> DataFrame:
    return stats.chi_square_cramers_v(d.line_items(spark, sf), d.LINE_CATS, "y").drop("p_value")


@query("st5_chi_square_plain", f"WITH {d.LINES}, {chi_sql('li', 'returnflag', False, False, *d.LINE_CATS)}", doubles="chi2 cramers_v", longs="n dof")
def st5b(spark: Spark, sf: str) -> DataFrame:
    return stats.chi_square_cramers_v(d.line_items(spark, sf), d.LINE_CATS, "returnflag", False, False).drop("p_value")


@query("st5_chi_square_sparse", f"WITH {d.DOCS}, {chi_sql('docs', 'source', False, False, 'lang', 'n_chars')}", doubles="chi2 cramers_v", longs="n dof")
def st5c(spark: Spark, sf: str) -> DataFrame:
    return stats.chi_square_cramers_v(d.labelled_documents(spark, sf), ["lang", "n_chars"], "source", False, False).drop("p_value")


KS = "sides AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {s} AS side, CAST({c} AS DOUBLE) AS value FROM {t}" for c in d.NUMS for s, t in ((0, "early"), (1, "late"))) + """),
 f AS (SELECT feature, value, sum(1 - side) OVER w / CAST(sum(1 - side) OVER (PARTITION BY feature) AS DOUBLE) AS fa,
   sum(side) OVER w / CAST(sum(side) OVER (PARTITION BY feature) AS DOUBLE) AS fb FROM sides WINDOW w AS (PARTITION BY feature ORDER BY value)),
 ks AS (SELECT feature, max(abs(fa - fb)) AS ks_statistic FROM f GROUP BY feature),
 m AS (SELECT feature, count(*) FILTER (side = 0) AS n_a, count(*) FILTER (side = 1) AS n_b, avg(value) FILTER (side = 0) AS mean_a, avg(value) FILTER (side = 1) AS mean_b,
   quantile_cont(value, 0.5) FILTER (side = 0) AS median_a, quantile_cont(value, 0.5) FILTER (side = 1) AS median_b,
   stddev_pop(value) FILTER (side = 0) AS std_a, stddev_pop(value) FILTER (side = 1) AS std_b FROM sides GROUP BY feature)"""


@query("st6_ks_two_sample", f"""WITH {d.SIDES}, {KS}
SELECT m.*, ks_statistic, mean_b - mean_a AS mean_delta, median_b - median_a AS median_delta, std_b - std_a AS std_delta FROM m JOIN ks USING (feature)""",
       doubles="ks_statistic mean_a mean_b median_a median_b std_a std_b mean_delta median_delta std_delta", longs="n_a n_b")
def st6(spark: Spark, sf: str) -> DataFrame:
    a, b = d.early_late(spark, sf)
    return stats.ks_two_sample(a, b, d.NUMS).drop("p_value")


@query("st7_categorical_drift", f"WITH {d.SIDES}, c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, coalesce(a.value, b.value) AS value, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b FROM (SELECT {c} AS value, count(*) AS n FROM early GROUP BY 1) AS a "
    f"FULL OUTER JOIN (SELECT {c} AS value, count(*) AS n FROM late GROUP BY 1) AS b ON a.value = b.value" for c in d.CATS) + """),
 s AS (SELECT *, sum(a) OVER (PARTITION BY feature) AS na, sum(b) OVER (PARTITION BY feature) AS nb FROM c),
 e AS (SELECT *, CAST(a + b AS DOUBLE) * na / (na + nb) AS ea, CAST(a + b AS DOUBLE) * nb / (na + nb) AS eb FROM s)
SELECT feature, sum(abs(a / na - b / nb)) / 2 AS total_variation_distance, max(abs(a / na - b / nb)) AS max_proportion_delta,
  sum(power(a - ea, 2) / ea + power(b - eb, 2) / eb) AS chi_square, count(*) AS categories FROM e GROUP BY feature""",
       doubles="total_variation_distance max_proportion_delta chi_square", longs="categories")
def st7(spark: Spark, sf: str) -> DataFrame:
    a, b = d.early_late(spark, sf)
    return stats.categorical_drift(a, b, d.CATS).drop("p_value")


@query("st8_smd_drift", f"WITH {d.SIDES}, m AS (" + stack("""
SELECT '{c}' AS feature, (SELECT avg({c}) FROM early) AS mean_a, (SELECT avg({c}) FROM late) AS mean_b,
  sqrt(((SELECT var_pop({c}) FROM early) + (SELECT var_pop({c}) FROM late)) / 2) AS s""", *d.NUMS) +
       ") SELECT feature, mean_a, mean_b, (mean_b - mean_a) / s AS smd, abs((mean_b - mean_a) / s) AS abs_smd FROM m", doubles="mean_a mean_b smd abs_smd")
def st8(spark: Spark, sf: str) -> DataFrame:
    a, b = d.early_late(spark, sf)
    return stats.smd_drift(a, b, d.NUMS)


@query("st9_redundancy", f"WITH {d.LINES}, c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS correlation FROM li" for i, a in enumerate(d.LINE_NUMS) for b in d.LINE_NUMS[i + 1:]) + """)
SELECT *, abs(correlation) AS abs_correlation, CASE WHEN abs(correlation) >= 0.9 THEN 'very_high' WHEN abs(correlation) >= 0.8 THEN 'high'
  WHEN abs(correlation) >= 0.7 THEN 'moderate' ELSE 'low' END AS level FROM c""", doubles="correlation abs_correlation")
def st9(spark: Spark, sf: str) -> DataFrame:
    return stats.redundancy(d.line_items(spark, sf), d.LINE_NUMS)


@query("st10_mutual_information", f"WITH {d.PRED}, {binned_sql('pred', 10, *d.NUMS)}, x AS (SELECT feature, CAST(bin AS VARCHAR) AS value, y FROM binned UNION ALL " + stack(
    "SELECT '{c}', {c}, y FROM pred", *d.CATS) + """), o AS (SELECT feature, value, y, count(*) AS o FROM x GROUP BY 1, 2, 3),
 t AS (SELECT *, sum(o) OVER (PARTITION BY feature, value) AS r, sum(o) OVER (PARTITION BY feature, y) AS c, sum(o) OVER (PARTITION BY feature) AS n FROM o)
SELECT feature, greatest(0, sum(o / n * ln(CAST(o AS DOUBLE) * n / (CAST(r AS DOUBLE) * c)))) AS mutual_information FROM t GROUP BY feature""",
       doubles="mutual_information")
def st10(spark: Spark, sf: str) -> DataFrame:
    return stats.mutual_information(d.predictions(spark, sf), d.CATS, d.NUMS, "y")


EFFECT = "g AS (" + stack("SELECT '{c}' AS feature, {c} AS value, count(*) AS n, avg(y) AS r, (SELECT avg(y) FROM pred) AS m FROM pred GROUP BY {c}", *d.CATS) + """),
 effect AS (SELECT feature, count(*) AS categories, max(abs(r - m)) AS max_rate_deviation, sqrt(sum(n * power(r - m, 2)) / sum(n)) AS effect_strength FROM g GROUP BY feature)"""


@query("st11_effect_strength", f"WITH {d.PRED}, {EFFECT} SELECT * FROM effect", doubles="max_rate_deviation effect_strength", longs="categories")
def st11(spark: Spark, sf: str) -> DataFrame:
    return stats.effect_strength(d.predictions(spark, sf), d.CATS, "y")


@query("st12_target_drift", f"""WITH {d.SIDES}
SELECT a.*, b.*, rate_b - rate_a AS difference_pp FROM (SELECT count(*) AS rows_a, sum(y) AS positives_a, avg(y) * 100 AS rate_a FROM early) AS a,
  (SELECT count(*) AS rows_b, sum(y) AS positives_b, avg(y) * 100 AS rate_b FROM late) AS b""",
       doubles="rate_a rate_b difference_pp", longs="rows_a rows_b positives_a positives_b")
def st12(spark: Spark, sf: str) -> DataFrame:
    a, b = d.early_late(spark, sf)
    return stats.target_drift(a, b, "y")


@query("st13_rank_features", f"WITH {d.PRED}, {EFFECT}, u AS (SELECT feature, 'categorical' AS kind, max_rate_deviation AS score FROM effect UNION ALL " + stack(
    "SELECT '{c}', 'numeric', abs(corr({c}, y)) FROM pred", *d.NUMS) + ") SELECT *, row_number() OVER (ORDER BY score DESC, feature) AS rank FROM u",
       doubles="score", longs="rank")
def st13(spark: Spark, sf: str) -> DataFrame:
    return stats.rank_features(d.predictions(spark, sf), d.NUMS, d.CATS, "y")


# --- J: joins and set operations ---------------------------------------------------------------

@query("j1_compare_relationships", f"WITH {d.SIDES}, r AS (" + stack(
    "SELECT '{c}' AS feature, (SELECT corr({c}, y) FROM early) AS train, (SELECT corr({c}, y) FROM late) AS holdout", *d.NUMS) +
       ") SELECT *, holdout - train AS delta, abs(holdout - train) AS abs_delta, sign(train) = sign(holdout) AS same_direction FROM r",
       doubles="train holdout delta abs_delta")
def j1(spark: Spark, sf: str) -> DataFrame:
    a, b = d.early_late(spark, sf)
    return compare.compare_relationships(stats.point_biserial(a, d.NUMS, "y"), stats.point_biserial(b, d.NUMS, "y"), "r")


@query("j1_compare_categories", f"""WITH {d.SIDES}, x AS ({' UNION ALL '.join(
    f"SELECT '{s}' AS side, feature, cramers_v FROM (WITH {chi_sql(s, 'y', True, True, *d.CATS)}) AS {s}_chi" for s in ('early', 'late'))})
SELECT a.feature, a.cramers_v AS train, b.cramers_v AS holdout, b.cramers_v - a.cramers_v AS delta, abs(b.cramers_v - a.cramers_v) AS abs_delta
FROM (SELECT * FROM x WHERE side = 'early') AS a FULL OUTER JOIN (SELECT * FROM x WHERE side = 'late') AS b ON a.feature = b.feature""",
       doubles="train holdout delta abs_delta")
def j1b(spark: Spark, sf: str) -> DataFrame:
    a, b = d.early_late(spark, sf)
    return compare.compare_relationships(stats.chi_square_cramers_v(a, d.CATS, "y"),
                                         stats.chi_square_cramers_v(b, d.CATS, "y"), "cramers_v", signed=False)


@query("j2_label_disagreement", f"""WITH {d.VERSION_B}, j AS (
  SELECT CASE WHEN a2.status = 'F' THEN 1 ELSE 0 END AS ya, CASE b2.answer WHEN '1' THEN 1 WHEN '0' THEN 0 END AS yb FROM a2 JOIN b2 USING (id))
SELECT count(*) AS shared_rows, count(yb) AS compared_rows, count(*) FILTER (ya <> yb) AS disagreements, count(*) FILTER (ya <> yb) / count(yb) AS disagreement_rate FROM j""",
       doubles="disagreement_rate", longs="shared_rows compared_rows disagreements")
def j2(spark: Spark, sf: str) -> DataFrame:
    return compare.label_disagreement(d.version_a(spark, sf), d.version_b(spark, sf), "id", "answer")


@query("j3_shared_row_diff", f"WITH {d.VERSION_B}, j AS (SELECT a2.price AS price_a, b2.price AS price_b, a2.balance AS balance_a, b2.balance AS balance_b, a2.segment AS segment_a, "
       "b2.segment AS segment_b, a2.status AS status_a, b2.status AS status_b FROM a2 JOIN b2 USING (id)) " + stack(
           "SELECT '{c}' AS feature, count(*) AS shared_rows, count(*) FILTER ({c}_a <> {c}_b) AS different_values, count(*) FILTER ({c}_a <> {c}_b) / count(*) AS difference_rate FROM j",
           "price", "balance", "segment", "status"), doubles="difference_rate", longs="shared_rows different_values")
def j3(spark: Spark, sf: str) -> DataFrame:
    return compare.shared_row_diff(d.version_a(spark, sf), d.version_b(spark, sf), "id", ["price", "balance", "segment", "status"])


OVERLAP = """SELECT sum(a) AS distinct_a, sum(b) AS distinct_b, count(*) FILTER (a = 1 AND b = 1) AS shared, count(*) FILTER (a = 1 AND b = 0) AS only_a,
  count(*) FILTER (a = 0 AND b = 1) AS only_b, count(*) FILTER (a = 1 AND b = 1) / sum(a) AS overlap_of_a, count(*) FILTER (a = 1 AND b = 1) / sum(b) AS overlap_of_b
FROM (SELECT max(a) AS a, max(b) AS b FROM (SELECT {k}, 1 AS a, 0 AS b FROM a2 UNION ALL SELECT {k}, 0, 1 FROM b2) AS u GROUP BY {k}) AS g"""


@query("j4_row_overlap", f"WITH {d.VERSION_B} {OVERLAP.format(k='id')}", doubles="overlap_of_a overlap_of_b", longs="distinct_a distinct_b shared only_a only_b")
def j4(spark: Spark, sf: str) -> DataFrame:
    return compare.row_overlap(d.version_a(spark, sf), d.version_b(spark, sf), ["id"])


@query("j4_row_overlap_whole_rows", f"WITH {d.VERSION_B} {OVERLAP.format(k='id, price, balance, priority, segment, status')}",
       doubles="overlap_of_a overlap_of_b", longs="distinct_a distinct_b shared only_a only_b")
def j4b(spark: Spark, sf: str) -> DataFrame:
    return compare.row_overlap(d.version_a(spark, sf), d.version_b(spark, sf), ["id", "price", "balance", "priority", "segment", "status"])


@query("j5_schema_diff")
def j5(spark: Spark, sf: str) -> DataFrame:
    b = d.version_b(spark, sf).withColumn("price", F.col("price").cast("int")).withColumn("extra", F.lit(1)).drop("placed")
    return compare.schema_diff(d.version_a(spark, sf), b)


@query("j8_union_results", f"""WITH {d.SIDES}
SELECT 'early' AS side, count(*) AS rows, avg(price) AS mean_price, NULL AS mean_balance FROM early UNION ALL SELECT 'late', count(*), NULL, avg(balance) FROM late""",
       doubles="mean_price mean_balance", longs="rows")
def j8(spark: Spark, sf: str) -> DataFrame:
    a, b = d.early_late(spark, sf)
    n = F.count(F.lit(1)).alias("rows")
    return compare.union_results(a.agg(n, F.avg("price").alias("mean_price")).withColumn("side", F.lit("early")),
                                 b.agg(n, F.avg("balance").alias("mean_balance")).withColumn("side", F.lit("late")))


@query("j9_distinct_rows", f"WITH {d.MESSY} SELECT DISTINCT * FROM messy", doubles="price balance", longs="id")
def j9(spark: Spark, sf: str) -> DataFrame:
    return compare.distinct_rows(d.messy_orders(spark, sf))


@query("j9_first_row_per_customer", f"""WITH {d.OC}, r AS (SELECT cust, placed, id, price, row_number() OVER (PARTITION BY cust ORDER BY placed, id) AS k FROM oc)
SELECT cust, strftime(placed, '%Y-%m-%d %H:%M:%S') AS placed, id, price FROM r WHERE k = 1""", doubles="price", longs="cust id")
def j9b(spark: Spark, sf: str) -> DataFrame:
    first = compare.distinct_rows(d.orders_customers(spark, sf).select("cust", "placed", "id", "price"), ["cust"], ["placed", "id"])
    return first.withColumn("placed", F.date_format("placed", "yyyy-MM-dd HH:mm:ss"))


@query("j11_align_predictions", f"""WITH {d.METHODS}
SELECT a.id, a.y, a.p AS p_a, b.p AS p_b, CAST(a.p >= 0.44 AS INT) AS flag_a, CAST(b.p >= 0.25 AS INT) AS flag_b
FROM (SELECT * FROM preds WHERE method = 'base') AS a JOIN (SELECT * FROM preds WHERE method = 'sigmoid') AS b ON a.id = b.id""",
       doubles="p_a p_b", longs="id y flag_a flag_b")
def j11(spark: Spark, sf: str) -> DataFrame:
    p = d.method_predictions(spark, sf)
    return compare.align_predictions(p.filter("method = 'base'"), p.filter("method = 'sigmoid'"), 0.44, 0.25)
