"""Sources, contract checks and text scans on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import number
from plumbline.operators import contract, profile, text
from plumbline.plans import datasets as d
from plumbline.plans.registry import query
from plumbline.session import work_folder
from plumbline.sources import fingerprint, readers, writers

Spark = SparkSession


def _scratch(spark: SparkSession) -> str:
    """A new folder for round-trip queries inside the shared work folder."""
    return f"{work_folder(spark)}/plumbline-{uuid.uuid4().hex}"


# --- S: sources and sinks --------------------------------------------------------------------

@query("s1_read_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
       doubles="c_acctbal", longs="c_custkey c_nationkey")
def s1(spark: Spark, sf: str) -> DataFrame:
    src = d.table(spark, sf, "customer")
    path = _scratch(spark) + "/customer.csv"
    src.write.option("header", True).csv(path)
    return readers.read_table(spark, path, src.schema)


@query("s2_read_any", "SELECT count(*) AS rows, sum(o_totalprice) AS total FROM orders",
       doubles="total", longs="rows")
def s2(spark: Spark, sf: str) -> DataFrame:
    return readers.read_any(spark, f"{sf}/orders.parquet").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("o_totalprice").alias("total"))


@query("s3_discover_datasets")
def s3(spark: Spark, sf: str) -> DataFrame:
    return readers.discover_datasets(spark, sf)


@query("s4_file_fingerprint")
def s4(spark: Spark, sf: str) -> DataFrame:
    return fingerprint.file_fingerprint(spark, f"{sf}/orders.parquet")


@query("s5_content_fingerprint")
def s5(spark: Spark, sf: str) -> DataFrame:
    return fingerprint.content_fingerprint(d.table(spark, sf, "lineitem"))


@query("s6_write_report_table", f"WITH {d.OC} SELECT 'priority' AS feature, priority AS category, count(*) AS total, "
       "sum(y) AS positives FROM oc GROUP BY priority UNION ALL SELECT 'segment', segment, count(*), sum(y) "
       "FROM oc GROUP BY segment", longs="total positives")
def s6(spark: Spark, sf: str) -> DataFrame:
    path = _scratch(spark) + "/rates"
    rates = profile.rate_by_category(d.orders_customers(spark, sf), d.CATS, "y")
    writers.write_report_table(rates, path, "csv", ["feature"])
    return spark.read.option("header", True).schema(rates.schema).csv(path).select(
        "feature", "category", "total", "positives")


@query("s7_write_report_json", """
SELECT o_orderkey AS id, '{"o_orderkey":' || o_orderkey || ',"status":"' || o_orderstatus || '","score":'
  || CASE WHEN o_orderstatus = 'F' THEN 'null' ELSE CAST(o_custkey AS VARCHAR) || '.5' END || '}' AS json FROM orders""")
def s7(spark: Spark, sf: str) -> DataFrame:
    nan = F.when(F.col("o_orderstatus") == "F", F.lit(float("nan"))).otherwise(F.col("o_custkey") + 0.5)
    rows = d.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), nan.alias("score"))
    plain = writers.to_json_rows(rows)
    return plain.select(F.get_json_object("json", "$.o_orderkey").cast("long").alias("id"), "json")


@query("s8_load_evidence", f"""WITH {d.OC} SELECT 'classes' AS name, TRUE AS required, TRUE AS available, count(DISTINCT status) AS rows FROM oc
UNION ALL SELECT 'target', TRUE, TRUE, 1 UNION ALL SELECT 'absent', FALSE, FALSE, 0""", longs="rows")
def s8(spark: Spark, sf: str) -> DataFrame:
    root = _scratch(spark)
    oc = d.orders_customers(spark, sf)
    writers.write_report_table(profile.class_counts(oc, "status"), f"{root}/classes.csv")
    writers.write_report_json(profile.target_summary(oc, "status", "F", "O"), f"{root}/target.json")
    _, status = readers.load_evidence(spark, {
        "classes": f"{root}/classes.csv", "target": f"{root}/target.json", "absent": f"{root}/absent.csv"},
        required=["classes", "target"])
    return status.select("name", "required", "available", "rows")


@query("s9_json_find", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events",
       doubles="k", longs="event_id")
def s9(spark: Spark, sf: str) -> DataFrame:
    return d.table(spark, sf, "events").select(
        "event_id", number(readers.json_find("props", ["k", "key"])).alias("k"))


# --- P: contracts ---------------------------------------------------------------------------------

@query("p1_audit_columns")
def p1(spark: Spark, sf: str) -> DataFrame:
    return contract.audit_columns(d.table(spark, sf, "orders"), [
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_clerk"])


@query("p2_audit_schema", f"""WITH {d.MESSY}
SELECT 'id' AS feature, 0 AS position, 'bigint' AS data_type, 1 AS columns_of_type, 1 AS name_count, count(*) - count(id) AS missing, count(DISTINCT id) AS unique_values FROM messy
UNION ALL SELECT 'price', 1, 'double', 2, 1, count(*) - count(price), count(DISTINCT price) FROM messy
UNION ALL SELECT 'balance', 2, 'double', 2, 1, count(*) - count(balance), count(DISTINCT balance) FROM messy
UNION ALL SELECT 'priority', 3, 'string', 3, 1, count(*) - count(priority), count(DISTINCT priority) FROM messy
UNION ALL SELECT 'segment', 4, 'string', 3, 1, count(*) - count(segment), count(DISTINCT segment) FROM messy
UNION ALL SELECT 'status', 5, 'string', 3, 1, count(*) - count(status), count(DISTINCT status) FROM messy""",
       longs="position columns_of_type name_count missing unique_values")
def p2(spark: Spark, sf: str) -> DataFrame:
    return contract.audit_schema(d.messy_orders(spark, sf))


@query("p5_encode_target_strict", "SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y "
       "FROM lineitem", longs="id line y")
def p5(spark: Spark, sf: str) -> DataFrame:
    padded = d.table(spark, sf, "lineitem").withColumn("l_linestatus", F.concat(F.lit(" "), F.lower("l_linestatus"), F.lit(" ")))
    return contract.encode_target_strict(padded, "l_linestatus", "F", "O").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "y")


@query("p5_unexpected_targets", "SELECT o_orderstatus AS value, count(*) AS count FROM orders "
       "WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 1", longs="count")
def p5b(spark: Spark, sf: str) -> DataFrame:
    return contract.unexpected_targets(d.table(spark, sf, "orders"), "o_orderstatus", "F", "O")


@query("p6_encode_target_lenient", f"""WITH {d.VERSION_B}
SELECT id, CASE WHEN lower(trim(answer)) = 'yes' THEN 1 ELSE 0 END AS y, 'semantic' AS mapping_method FROM a2""",
       longs="id y")
def p6(spark: Spark, sf: str) -> DataFrame:
    return contract.encode_target_lenient(d.version_a(spark, sf), "answer").select("id", "y", "mapping_method")


@query("p6_encode_target_by_order", """
SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y,
       'sorted_values' AS mapping_method FROM lineitem""", longs="id line y")
def p6b(spark: Spark, sf: str) -> DataFrame:
    return contract.encode_target_lenient(d.table(spark, sf, "lineitem"), "l_linestatus").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "y", "mapping_method")


@query("p7_feature_matrix", f"WITH {d.OC} SELECT price, balance, priority, segment, y FROM oc",
       doubles="price balance", longs="y")
def p7(spark: Spark, sf: str) -> DataFrame:
    return contract.feature_matrix(d.orders_customers(spark, sf), d.NUMS + d.CATS, "y")


@query("p8_coerce_numeric", """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  TRY_CAST(event_type AS DOUBLE) AS event_type FROM events""", doubles="k event_type", longs="event_id")
def p8(spark: Spark, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    return contract.coerce_numeric(e, ["k", "event_type"])


@query("p9_range_checks", """
SELECT 'c_acctbal' AS feature, 'negative' AS "check", count(*) FILTER (c_acctbal < 0) AS violations FROM customer
UNION ALL SELECT 'c_acctbal', 'out_of_range', count(*) FILTER (c_acctbal < 0 OR c_acctbal > 5000) FROM customer""",
       longs="violations")
def p9(spark: Spark, sf: str) -> DataFrame:
    return contract.range_checks(d.table(spark, sf, "customer"), ["c_acctbal"], {"c_acctbal": (0, 5000)})


DOMAINS = {"status": ["F", "O"], "priority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}


@query("p10_domain_checks", f"""WITH {d.OC}, x AS (
  SELECT 'status' AS feature, status AS value, status NOT IN ('F', 'O') AS bad FROM oc
  UNION ALL SELECT 'priority', priority, priority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') FROM oc)
SELECT feature, count(DISTINCT value) AS observed_values, count(DISTINCT CASE WHEN bad THEN value END) AS unexpected_values,
  count(*) FILTER (bad) AS unexpected_rows, min(CASE WHEN bad THEN value END) AS first_unexpected FROM x GROUP BY feature""",
       longs="observed_values unexpected_values unexpected_rows")
def p10(spark: Spark, sf: str) -> DataFrame:
    return contract.domain_checks(d.orders_customers(spark, sf), DOMAINS)


@query("p10_domain_violations", "SELECT 'status' AS feature, o_orderstatus AS value, count(*) AS count FROM orders "
       "WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 2", longs="count")
def p10b(spark: Spark, sf: str) -> DataFrame:
    return contract.domain_violations(d.orders_customers(spark, sf), DOMAINS)


@query("p11_consistency_rules", """
SELECT 'l_discount <= l_tax' AS rule, count(*) AS checked_rows, count(*) FILTER (l_discount > l_tax) AS violations,
  count(*) FILTER (l_discount > l_tax) / count(*) AS violation_rate FROM lineitem
UNION ALL SELECT 'l_quantity <= l_extendedprice', count(*), count(*) FILTER (l_quantity > l_extendedprice),
  count(*) FILTER (l_quantity > l_extendedprice) / count(*) FROM lineitem""",
       doubles="violation_rate", longs="checked_rows violations")
def p11(spark: Spark, sf: str) -> DataFrame:
    return contract.consistency_rules(d.table(spark, sf, "lineitem"),
                                      [("l_discount", "l_tax"), ("l_quantity", "l_extendedprice")])


@query("p12_filter_impact", f"""WITH {d.MESSY}, m AS (
  SELECT id, price, balance, priority, segment, CASE status WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE status END AS answer FROM messy),
 sets AS (
  SELECT 'original' AS operation, answer FROM m
  UNION ALL SELECT 'drop_rows_with_any_missing', answer FROM m WHERE price IS NOT NULL AND balance IS NOT NULL
    AND priority IS NOT NULL AND segment IS NOT NULL AND answer IS NOT NULL
  UNION ALL SELECT 'drop_exact_duplicate_rows', answer FROM (SELECT DISTINCT * FROM m) AS q
  UNION ALL SELECT 'keep_rows_with_valid_target', answer FROM m WHERE answer IN ('yes', 'no'))
SELECT operation, (SELECT count(*) FROM m) AS rows_before, count(*) AS rows_after, (SELECT count(*) FROM m) - count(*) AS rows_removed,
  100.0 * count(*) / (SELECT count(*) FROM m) AS retained_percent, count(*) FILTER (answer IN ('yes', 'no')) AS valid_target_rows,
  count(*) FILTER (answer = 'yes') AS positives,
  100.0 * count(*) FILTER (answer = 'yes') / count(*) FILTER (answer IN ('yes', 'no')) AS prevalence_percent
FROM sets GROUP BY operation""", doubles="retained_percent prevalence_percent",
       longs="rows_before rows_after rows_removed valid_target_rows positives")
def p12(spark: Spark, sf: str) -> DataFrame:
    m = d.messy_orders(spark, sf).withColumn("answer", F.when(F.col("status") == "F", "yes").when(
        F.col("status") == "O", "no").otherwise(F.col("status"))).drop("status")
    return contract.filter_impact(m, "answer")


@query("p13_flag_at", f"WITH {d.PRED} SELECT id, p, CAST(p >= 0.25 AS BIGINT) AS flag FROM pred", doubles="p", longs="id")
def p13(spark: Spark, sf: str) -> DataFrame:
    return contract.flag_at(d.predictions(spark, sf).select("id", "p"), "p", 0.25)


@query("p14_pick_row", f"""WITH {d.METHODS}
SELECT method, count(*) AS rows, avg(p) AS mean_p FROM preds WHERE method = 'sigmoid' GROUP BY method""",
       doubles="mean_p", longs="rows")
def p14(spark: Spark, sf: str) -> DataFrame:
    by = d.method_predictions(spark, sf).groupBy("method").agg(F.count(F.lit(1)).alias("rows"), F.avg("p").alias("mean_p"))
    return contract.pick_row(by, "method", " SIGM", contains=True)


@query("p15_within_tolerance", f"""WITH {d.METHODS}
SELECT method, avg(p) AS mean_p, avg(y) AS rate, abs(avg(p) - avg(y)) <= 0.02 AS close FROM preds GROUP BY method""",
       doubles="mean_p rate")
def p15(spark: Spark, sf: str) -> DataFrame:
    by = d.method_predictions(spark, sf).groupBy("method").agg(F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))
    return by.withColumn("close", contract.within_tolerance(F.col("mean_p"), F.col("rate"), 0.02))


@query("p17_logistic_risk", f"WITH {d.OC} SELECT id, {d.RISK} AS p FROM oc", doubles="p", longs="id")
def p17(spark: Spark, sf: str) -> DataFrame:
    return contract.logistic_risk(d.orders_customers(spark, sf), d.RISK_TERMS, d.RISK_INTERCEPT).select("id", "p")


@query("p18_canonical_checks", f"""WITH {d.OC}, f AS (
  SELECT count(*) AS n, count(*) FILTER (status = 'F') AS pos, count(*) FILTER (status = 'O') AS neg,
    count(*) FILTER (status IS NULL) AS gone, count(DISTINCT id) AS ids,
    count(*) FILTER (price IS NULL OR balance IS NULL OR id IS NULL OR priority IS NULL OR segment IS NULL) AS holes,
    (SELECT count(*) FROM (SELECT DISTINCT * FROM oc) AS q) AS distinct_rows FROM oc),
 c AS (SELECT 'expected_rows' AS "check", n = 15000 AS passed FROM f
  UNION ALL SELECT 'expected_columns', TRUE FROM f UNION ALL SELECT 'target_values_valid', pos + neg = n - gone FROM f
  UNION ALL SELECT 'target_complete', gone = 0 FROM f UNION ALL SELECT 'positive_count', pos = 5000 FROM f
  UNION ALL SELECT 'negative_count', neg = 5000 FROM f UNION ALL SELECT 'prevalence', abs(pos / n - 0.33) <= 0.01 FROM f
  UNION ALL SELECT 'feature_count', TRUE FROM f UNION ALL SELECT 'identifier_unique', ids = n FROM f
  UNION ALL SELECT 'no_missing_cells', holes = 0 FROM f UNION ALL SELECT 'no_duplicate_rows', distinct_rows = n FROM f)
SELECT "check", passed FROM c UNION ALL SELECT 'all_passed', bool_and(passed) FROM c""")
def p18(spark: Spark, sf: str) -> DataFrame:
    return contract.canonical_checks(d.orders_customers(spark, sf), {
        "rows": 15000, "columns": 9, "id": "id", "target": "status", "positive": "F", "negative": "O",
        "positives": 5000, "negatives": 5000, "prevalence": 0.33, "prevalence_tolerance": 0.01,
        "features": d.NUMS + d.CATS})


@query("p19_scan_text", """
SELECT doc_id, line_number, pattern, hits, content FROM (
  SELECT doc_id, line_number, trim(line, ' ') AS content, unnest([
    {'pattern': 'email', 'hits': len(regexp_extract_all(line, '[a-z0-9.]+@[a-z0-9.]+'))},
    {'pattern': 'license', 'hits': len(regexp_extract_all(line, '[Ll]icen[sc]e'))},
    {'pattern': 'number', 'hits': len(regexp_extract_all(line, '[0-9]{4,}'))}], recursive := true)
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents) AS l) AS x
WHERE hits > 0""", longs="doc_id line_number hits")
def p19(spark: Spark, sf: str) -> DataFrame:
    return text.scan_text(d.table(spark, sf, "documents"), "text", {
        "email": "[a-z0-9.]+@[a-z0-9.]+", "license": "[Ll]icen[sc]e", "number": "[0-9]{4,}"}, ["doc_id"])


@query("p20_replace_text", """
SELECT doc_id, n AS replacements, CASE WHEN n = 0 THEN 'already_canonical' ELSE 'updated' END AS status, md5(updated) AS digest
FROM (SELECT doc_id, len(regexp_extract_all(text, '[0-9]{3,}')) AS n, regexp_replace(text, '[0-9]{3,}', '<number>', 'g') AS updated FROM documents) AS x""",
       longs="doc_id replacements")
def p20(spark: Spark, sf: str) -> DataFrame:
    return text.replace_text(d.table(spark, sf, "documents"), "text", "[0-9]{3,}", "<number>").select(
        "doc_id", "replacements", "status", F.md5("updated").alias("digest"))
