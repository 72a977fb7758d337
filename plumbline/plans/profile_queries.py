"""Profiles and target rates on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import profile, stats
from plumbline.plans import datasets as d
from plumbline.plans.registry import query

Spark = SparkSession


def stack(rows: str, *names: str) -> str:
    """The same SELECT for several columns, glued with UNION ALL ({c} is the column)."""
    return " UNION ALL ".join(rows.format(c=n) for n in names)


MESSY_COLS = ("id", "price", "balance", "priority", "segment", "status")


@query("a1_table_structure", f"""WITH {d.MESSY}
SELECT count(*) AS rows, 6 AS columns, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy) AS q) AS duplicate_rows,
  count(*) - count(DISTINCT id) AS duplicate_ids,
  5 * count(*) - count(price) - count(balance) - count(priority) - count(segment) - count(status) AS missing_cells,
  100.0 * (5 * count(*) - count(price) - count(balance) - count(priority) - count(segment) - count(status)) / (6 * count(*)) AS missing_percent
FROM messy""", doubles="missing_percent", longs="rows columns duplicate_rows duplicate_ids missing_cells")
def a1(spark: Spark, sf: str) -> DataFrame:
    return profile.table_structure(d.messy_orders(spark, sf), "id")


@query("a2_duplicate_audit", f"""WITH {d.MESSY}, g AS (SELECT count(*) AS n FROM messy GROUP BY id, price, balance, priority, segment, status)
SELECT sum(n - 1) AS duplicates_keep_first, sum(n) FILTER (n > 1) AS duplicates_all_members,
  count(*) FILTER (n > 1) AS duplicate_groups FROM g""",
       longs="duplicates_keep_first duplicates_all_members duplicate_groups")
def a2(spark: Spark, sf: str) -> DataFrame:
    return profile.duplicate_audit(d.messy_orders(spark, sf))


@query("a2_id_audit", f"""WITH {d.MESSY}
SELECT 'id' AS feature, count(DISTINCT id) AS unique_count, count(*) - count(DISTINCT id) AS duplicate_count, count(*) - count(id) AS missing_count FROM messy
UNION ALL SELECT 'price', count(DISTINCT price), count(*) - count(DISTINCT price) - 1, count(*) - count(price) FROM messy""",
       longs="unique_count duplicate_count missing_count")
def a2b(spark: Spark, sf: str) -> DataFrame:
    return profile.id_audit(d.messy_orders(spark, sf), ["id", "price"])


@query("a3_missingness", f"WITH {d.MESSY} " + stack(
    "SELECT '{c}' AS feature, count(*) - count({c}) AS missing, count(*) AS rows, 100.0 * (count(*) - count({c})) / count(*) AS missing_percent FROM messy", *MESSY_COLS),
       doubles="missing_percent", longs="missing rows")
def a3(spark: Spark, sf: str) -> DataFrame:
    return profile.missingness(d.messy_orders(spark, sf))


@query("a3_most_missing", f"WITH {d.MESSY}, m AS (" + stack(
    "SELECT '{c}' AS feature, count(*) - count({c}) AS missing, count(*) AS rows, 100.0 * (count(*) - count({c})) / count(*) AS missing_percent FROM messy", *MESSY_COLS)
       + ") SELECT * FROM m ORDER BY missing DESC, feature LIMIT 3", doubles="missing_percent", longs="missing rows")
def a3b(spark: Spark, sf: str) -> DataFrame:
    return profile.missingness(d.messy_orders(spark, sf), top=3)


@query("a3_missing_rows", f"""WITH {d.MESSY}, g AS (SELECT CAST(price IS NULL AS INT) + CAST(balance IS NULL AS INT) + CAST(priority IS NULL AS INT)
  + CAST(segment IS NULL AS INT) + CAST(status IS NULL AS INT) AS gaps FROM messy)
SELECT count(*) FILTER (gaps > 0) AS rows_with_any_missing, count(*) FILTER (gaps = 0) AS complete_rows, sum(gaps) AS missing_cells FROM g""",
       longs="rows_with_any_missing complete_rows missing_cells")
def a3c(spark: Spark, sf: str) -> DataFrame:
    return profile.missing_rows(d.messy_orders(spark, sf))


@query("a4_numeric_profile", f"WITH {d.LINES} " + stack("""
SELECT '{c}' AS feature, count({c}) AS count, count(*) - count({c}) AS missing, avg({c}) AS mean, stddev_samp({c}) AS std,
  min({c}) AS min, max({c}) AS max, count(*) FILTER ({c} = 0) AS zero_count, count(*) FILTER ({c} < 0) AS negative_count,
  quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75,
  count(DISTINCT {c}) AS unique_values FROM li""", *d.LINE_NUMS), digits=5,
       doubles="mean std min max q25 median q75", longs="count missing zero_count negative_count unique_values")
def a4(spark: Spark, sf: str) -> DataFrame:
    return profile.numeric_profile(d.line_items(spark, sf), d.LINE_NUMS)


@query("a4_numeric_profile_gaps", f"WITH {d.MESSY} " + stack("""
SELECT '{c}' AS feature, count({c}) AS count, count(*) - count({c}) AS missing, avg({c}) AS mean, stddev_samp({c}) AS std,
  min({c}) AS min, max({c}) AS max, count(*) FILTER ({c} = 0) AS zero_count, count(*) FILTER ({c} < 0) AS negative_count,
  quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75,
  count(DISTINCT {c}) AS unique_values FROM messy""", *d.NUMS),
       doubles="mean std min max q25 median q75", longs="count missing zero_count negative_count unique_values")
def a4b(spark: Spark, sf: str) -> DataFrame:
    return profile.numeric_profile(d.messy_orders(spark, sf), d.NUMS)


@query("a5_categorical_profile", f"WITH {d.LINES} " + stack(
    "SELECT '{c}' AS feature, {c} AS value, count(*) AS count, 100.0 * count(*) / (SELECT count(*) FROM li) AS percent FROM li GROUP BY {c}",
    "returnflag", *d.LINE_CATS), doubles="percent", longs="count")
def a5(spark: Spark, sf: str) -> DataFrame:
    return profile.categorical_profile(d.line_items(spark, sf), ["returnflag", *d.LINE_CATS])


@query("a5_categorical_profile_top", f"WITH {d.MESSY}, c AS (" + stack(
    "SELECT '{c}' AS feature, {c} AS value, count(*) AS count, 100.0 * count(*) / (SELECT count(*) FROM messy) AS percent FROM messy GROUP BY {c}",
    "priority", "segment") + """), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY count DESC, value ASC NULLS LAST) AS rank FROM c)
SELECT * FROM r WHERE rank <= 3""", doubles="percent", longs="count rank")
def a5b(spark: Spark, sf: str) -> DataFrame:
    return profile.categorical_profile(d.messy_orders(spark, sf), ["priority", "segment"], top=3)


@query("a5_category_extremes", f"WITH {d.MESSY}, c AS (" + stack(
    "SELECT '{c}' AS feature, {c} AS value, count(*) AS n FROM messy WHERE {c} IS NOT NULL GROUP BY {c}", "priority", "segment") + """)
SELECT feature, count(*) AS categories, first(value ORDER BY n DESC, value) AS most_common, max(n) AS most_common_count,
  first(value ORDER BY n, value) AS least_common, min(n) AS least_common_count,
  100.0 * max(n) / sum(n) AS most_common_percent, 100.0 * min(n) / sum(n) AS least_common_percent FROM c GROUP BY feature""",
       doubles="most_common_percent least_common_percent", longs="categories most_common_count least_common_count")
def a5c(spark: Spark, sf: str) -> DataFrame:
    return profile.category_extremes(d.messy_orders(spark, sf), ["priority", "segment"])


@query("a6_feature_summary", f"WITH {d.MESSY} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing, count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INT) AS unique_values, "
    f"100.0 * (count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INT)) / count(*) AS unique_percent, '{t}' AS data_type FROM messy"
    for c, t in zip(MESSY_COLS, ("bigint", "double", "double", "string", "string", "string"))),
       doubles="unique_percent", longs="missing unique_values")
def a6(spark: Spark, sf: str) -> DataFrame:
    return profile.feature_summary(d.messy_orders(spark, sf))


@query("a7_randomness_indicators", f"WITH {d.LINES} " + stack("""
SELECT '{c}' AS feature, count(DISTINCT {c}) / count({c}) AS unique_ratio, bool_and(abs({c} - round({c})) <= 1e-8 + 1e-5 * abs(round({c}))) AS integer_like,
  avg({c}) AS mean, stddev_samp({c}) AS std FROM li""", *d.LINE_NUMS), doubles="unique_ratio mean std", digits=5)
def a7(spark: Spark, sf: str) -> DataFrame:
    return profile.randomness_indicators(d.line_items(spark, sf), d.LINE_NUMS)


@query("a8_variance_audit", f"WITH {d.OC}, v AS (SELECT *, 'same' AS constant_text, CASE WHEN price > 495000 THEN 1 ELSE 0 END AS rare FROM oc), c AS (" + stack(
    "SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM v GROUP BY {c}", "constant_text", "rare", "status", "priority") + """)
SELECT feature, count(*) AS unique_values, max(n) / sum(n) AS top_share, count(*) <= 1 AS constant,
  count(*) > 1 AND max(n) / sum(n) >= 0.95 AS near_constant FROM c GROUP BY feature""", doubles="top_share", longs="unique_values")
def a8(spark: Spark, sf: str) -> DataFrame:
    v = d.orders_customers(spark, sf).withColumn("constant_text", F.lit("same")).withColumn(
        "rare", F.when(F.col("price") > 495000, 1).otherwise(0))
    return profile.variance_audit(v, ["constant_text", "rare", "status", "priority"])


@query("a9_target_summary", f"""WITH {d.MESSY}
SELECT count(*) AS rows, count(*) FILTER (status = 'F') AS positive_count, count(*) FILTER (status = 'O') AS negative_count,
  count(*) FILTER (status IS NULL) AS missing_count, count(*) FILTER (status NOT IN ('F', 'O')) AS unexpected_count,
  count(*) FILTER (status = 'F') / count(*) AS positive_rate, (count(*) FILTER (status = 'F') / count(*) - 0.236) * 100 AS delta_pp FROM messy""",
       doubles="positive_rate delta_pp", longs="rows positive_count negative_count missing_count unexpected_count")
def a9(spark: Spark, sf: str) -> DataFrame:
    return profile.target_summary(d.messy_orders(spark, sf), "status", "F", "O", 0.236)


@query("a9_class_counts", f"WITH {d.MESSY} SELECT status AS value, count(*) AS count, 100.0 * count(*) / (SELECT count(*) FROM messy) AS percent "
       "FROM messy GROUP BY status", doubles="percent", longs="count")
def a9b(spark: Spark, sf: str) -> DataFrame:
    return profile.class_counts(d.messy_orders(spark, sf), "status")


@query("a10_target_entropy", f"""WITH {d.LINES}, c AS (SELECT count(*) / (SELECT count(*) FROM li) AS s, count(*) AS n FROM li GROUP BY returnflag)
SELECT sum(n) AS rows, sum(-s * log2(s)) AS entropy_bits FROM c""", doubles="entropy_bits", longs="rows")
def a10(spark: Spark, sf: str) -> DataFrame:
    return profile.target_entropy(d.line_items(spark, sf), "returnflag")


def rate_sql(src: str, *cats: str) -> str:
    return stack(f"SELECT '{{c}}' AS feature, {{c}} AS category, count(*) AS total, sum(y) AS positives, 100.0 * sum(y) / count(*) AS rate_percent, "
                 f"(avg(y) - (SELECT avg(y) FROM {src})) * 100 AS deviation_pp FROM {src} GROUP BY {{c}}", *cats)


@query("a11_rate_by_category", f"WITH {d.OC} {rate_sql('oc', *d.CATS)}", doubles="rate_percent deviation_pp", longs="total positives")
def a11(spark: Spark, sf: str) -> DataFrame:
    return profile.rate_by_category(d.orders_customers(spark, sf), d.CATS, "y")


@query("a11_rate_by_category_lines", f"WITH {d.LINES} {rate_sql('li', *d.LINE_CATS)}", doubles="rate_percent deviation_pp", longs="total positives")
def a11b(spark: Spark, sf: str) -> DataFrame:
    return profile.rate_by_category(d.line_items(spark, sf), d.LINE_CATS, "y")


@query("a11_rate_by_category_documents", f"WITH {d.DOCS}, x AS (SELECT *, quality AS y FROM docs) {rate_sql('x', 'lang', 'source')}",
       doubles="rate_percent deviation_pp", longs="total positives")
def a11c(spark: Spark, sf: str) -> DataFrame:
    return profile.rate_by_category(d.labelled_documents(spark, sf), ["lang", "source"], "quality")


@query("a12_numeric_by_class", f"WITH {d.LINES} " + stack("""
SELECT returnflag, '{c}' AS feature, count({c}) AS count, round_even(avg({c}), 2) AS mean, round_even(stddev_samp({c}), 2) AS std, round_even(min({c}), 2) AS min,
  round_even(max({c}), 2) AS max, round_even(quantile_cont({c}, 0.5), 2) AS median FROM li GROUP BY returnflag""", *d.LINE_NUMS),
       doubles="mean std min max median", longs="count")
def a12(spark: Spark, sf: str) -> DataFrame:
    return profile.numeric_by_class(d.line_items(spark, sf), d.LINE_NUMS, "returnflag")


def binned_sql(src: str, bins: int, *nums: str) -> str:
    """CTE ``binned(feature, y, value, bin, lower, upper)`` of right-closed quantile bins."""
    probs = ", ".join(str(i / bins) for i in range(bins + 1))
    long = stack(f"SELECT '{{c}}' AS feature, y, CAST({{c}} AS DOUBLE) AS value FROM {src} WHERE {{c}} IS NOT NULL AND y IS NOT NULL", *nums)
    return f"""long AS ({long}),
 edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [{probs}]))) AS e FROM long GROUP BY feature),
 binned AS (SELECT feature, y, value, greatest(len(list_filter(e, lambda t: t < value)) - 1, 0) AS bin, e FROM long JOIN edges USING (feature))"""


RATE_BINS = """SELECT feature, bin, e[bin + 1] AS lower, e[bin + 2] AS upper, count(*) AS count, sum(y) AS positives, avg(y) AS rate,
  (SELECT avg(y) FROM {src}) AS overall_rate, avg(y) - (SELECT avg(y) FROM {src}) AS rate_difference FROM binned GROUP BY feature, bin, e"""


@query("a13_rate_by_quantile", f"WITH {d.LINES}, {binned_sql('li', 4, *d.LINE_NUMS)} {RATE_BINS.format(src='li')}",
       doubles="lower upper rate overall_rate rate_difference", longs="bin count positives")
def a13(spark: Spark, sf: str) -> DataFrame:
    return profile.rate_by_quantile(d.line_items(spark, sf), d.LINE_NUMS, "y", 4)


@query("a13_rate_by_quintile_range", f"WITH {d.OC}, {binned_sql('oc', 5, *d.NUMS)}, r AS ({RATE_BINS.format(src='oc')}) "
       "SELECT feature, min(rate) * 100 AS lowest_rate, max(rate) * 100 AS highest_rate, (max(rate) - min(rate)) * 100 AS rate_range_pp FROM r GROUP BY feature",
       doubles="lowest_rate highest_rate rate_range_pp")
def a13b(spark: Spark, sf: str) -> DataFrame:
    return profile.quantile_rate_range(profile.rate_by_quantile(d.orders_customers(spark, sf), d.NUMS, "y", 5))


PAIRS = [("price", "priority"), ("price", "balance"), ("segment", "priority")]
LEVELS = """lv AS (SELECT y, CASE WHEN price <= (SELECT quantile_cont(price, 0.5) FROM oc) THEN 'Low' ELSE 'High' END AS price,
  CASE WHEN balance <= (SELECT quantile_cont(balance, 0.5) FROM oc) THEN 'Low' ELSE 'High' END AS balance, priority, segment FROM oc),
 inter AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {a} || ' | ' || {b} AS interaction_group, count(*) AS count, avg(y) AS rate FROM lv GROUP BY {a}, {b}"
    for a, b in PAIRS) + ")"


@query("a14_interaction_rates", f"WITH {d.OC}, {LEVELS} SELECT * FROM inter", doubles="rate", longs="count")
def a14(spark: Spark, sf: str) -> DataFrame:
    return profile.interaction_rates(d.orders_customers(spark, sf), PAIRS, "y")


@query("a14_interaction_range", f"WITH {d.OC}, {LEVELS} SELECT feature_a, feature_b, min(rate) AS min_rate, max(rate) AS max_rate, max(rate) - min(rate) AS rate_range "
       "FROM inter GROUP BY feature_a, feature_b", doubles="min_rate max_rate rate_range")
def a14b(spark: Spark, sf: str) -> DataFrame:
    return profile.interaction_range(profile.interaction_rates(d.orders_customers(spark, sf), PAIRS, "y"))


@query("a15_crosstab", f"WITH {d.MESSY} SELECT priority AS a, status AS b, count(*) AS count FROM messy WHERE priority IS NOT NULL AND status IS NOT NULL GROUP BY 1, 2",
       longs="count")
def a15(spark: Spark, sf: str) -> DataFrame:
    return profile.crosstab(d.messy_orders(spark, sf), "priority", "status")


@query("a18_probability_stats", f"""WITH {d.PRED}
SELECT count(p) AS rows, min(p) AS min, max(p) AS max, avg(p) AS mean, stddev_pop(p) AS std, """ + ", ".join(
    f"quantile_cont(p, {q}) AS p{round(q * 100):02d}" for q in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM pred",
       doubles="min max mean std p01 p05 p10 p25 p50 p75 p90 p95 p99", longs="rows")
def a18(spark: Spark, sf: str) -> DataFrame:
    return profile.probability_stats(d.predictions(spark, sf))


@query("a18_probability_stats_by_method", f"""WITH {d.METHODS}
SELECT method, count(p) AS rows, min(p) AS min, max(p) AS max, avg(p) AS mean, stddev_pop(p) AS std, """ + ", ".join(
    f"quantile_cont(p, {q}) AS p{round(q * 100):02d}" for q in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM preds GROUP BY method",
       doubles="min max mean std p01 p05 p10 p25 p50 p75 p90 p95 p99", longs="rows")
def a18b(spark: Spark, sf: str) -> DataFrame:
    return profile.probability_stats(d.method_predictions(spark, sf), keys=["method"])


@query("a19_histogram", f"WITH {d.OC}, h AS (" + stack("""
SELECT '{c}' AS feature, least(floor(({c} - lo) / ((hi - lo) / 20)), 19) AS bin, lo, hi FROM oc, (SELECT min({c}) AS lo, max({c}) AS hi FROM oc) AS s""", *d.NUMS) + """),
 frame AS (SELECT DISTINCT feature, lo, hi, bin FROM (SELECT DISTINCT feature, lo, hi FROM h) AS f, (SELECT unnest(range(20)) AS bin) AS b)
SELECT f.feature, f.bin, f.lo + (f.hi - f.lo) / 20 * f.bin AS lower, f.lo + (f.hi - f.lo) / 20 * (f.bin + 1) AS upper, count(h.bin) AS count
FROM frame f LEFT JOIN h ON h.feature = f.feature AND h.bin = f.bin GROUP BY f.feature, f.bin, f.lo, f.hi""",
       doubles="lower upper", longs="bin count")
def a19(spark: Spark, sf: str) -> DataFrame:
    return profile.histogram(d.orders_customers(spark, sf), d.NUMS, 20)


@query("a19_box_summary", f"WITH {d.LINES} " + stack("""
SELECT returnflag, '{c}' AS feature, min({c}) AS min, any_value(q1) AS q25, any_value(q2) AS median, any_value(q3) AS q75, max({c}) AS max,
  min({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers
FROM li JOIN (SELECT returnflag, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM li GROUP BY returnflag) AS q
  USING (returnflag) GROUP BY returnflag""", "quantity", "price"),
       doubles="min q25 median q75 max whisker_low whisker_high", longs="outliers")
def a19b(spark: Spark, sf: str) -> DataFrame:
    return profile.box_summary(d.line_items(spark, sf), ["quantity", "price"], "returnflag").drop("lo_fence", "hi_fence")


@query("a19_score_histogram", f"WITH {d.PRED} SELECT y, len(list_filter([" + ", ".join(str(i / 20) for i in range(1, 20)) + "], lambda t: CAST(t AS DOUBLE) <= p)) AS bin, "
       "count(*) AS count FROM pred GROUP BY 1, 2", longs="y bin count")
def a19c(spark: Spark, sf: str) -> DataFrame:
    return profile.score_histogram(d.predictions(spark, sf))


@query("a20_dataset_profile", f"""WITH {d.MESSY}, {d.VERSION_B[len(d.OC) + 2:]}
SELECT 'messy' AS dataset, 6 AS columns, count(*) AS rows, count(*) FILTER (status = 'F') AS positive_count, count(*) FILTER (status = 'F') / count(*) AS positive_rate,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy) AS q) AS duplicates_keep_first,
  5 * count(*) - count(price) - count(balance) - count(priority) - count(segment) - count(status) AS missing_cells,
  count(*) FILTER (price IS NULL OR priority IS NULL OR status IS NULL) AS rows_with_any_missing FROM messy
UNION ALL SELECT 'version_b', 9, count(*), count(*) FILTER (status = 'F'), count(*) FILTER (status = 'F') / count(*), 0, 0, 0 FROM b2""",
       doubles="positive_rate", longs="columns rows positive_count duplicates_keep_first missing_cells rows_with_any_missing")
def a20(spark: Spark, sf: str) -> DataFrame:
    return profile.dataset_profile({"messy": (d.messy_orders(spark, sf), "status", "F", "O"),
                                    "version_b": (d.version_b(spark, sf), "status", "F", "O")}
                                   ).drop("schema_hash", "content_hash")


@query("a17_signal_concentration", f"""WITH {d.LINES}, r AS (""" + stack("SELECT abs(corr({c}, y)) AS r FROM li", *d.LINE_NUMS) + "), c AS ("
       + stack("SELECT '{c}' AS feature, {c} AS value, count(*) AS n, sum(y) AS k FROM li GROUP BY {c}", *d.LINE_CATS) + """),
 t AS (SELECT avg(y) AS m, count(*) AS n FROM li),
 v AS (SELECT feature, sqrt(sum(c.n * power(k / c.n - m, 2) / (m * (1 - m))) / any_value(t.n)) AS v, max(abs(k / c.n - m)) AS dev FROM c, t GROUP BY feature)
SELECT max(r) AS max_abs_r, count(*) FILTER (r >= 0.05) AS features_ge_005, count(*) FILTER (r >= 0.10) AS features_ge_010,
  (SELECT max(v) FROM v) AS max_cramers_v, (SELECT max(dev) FROM v) AS max_category_deviation FROM r""",
       doubles="max_abs_r max_cramers_v max_category_deviation", longs="features_ge_005 features_ge_010")
def a17(spark: Spark, sf: str) -> DataFrame:
    li = d.line_items(spark, sf)
    v = stats.chi_square_cramers_v(li, d.LINE_CATS, "y", yates=False, bias_correction=False).select("feature", "cramers_v")
    dev = stats.effect_strength(li, d.LINE_CATS, "y").select("feature", F.col("max_rate_deviation").alias("max_deviation"))
    return profile.signal_concentration(stats.point_biserial(li, d.LINE_NUMS, "y"), v.join(dev, "feature"))
