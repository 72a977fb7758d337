"""Bindings of the given tables, each as a DataFrame and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.operators.contract import logistic_risk


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its schema is read from the footer once, not for every query."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# --- labelled table: orders with their customer -----------------------------------------

OC = """oc AS (
  SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice AS price, c_acctbal AS balance,
         o_orderpriority AS priority, c_mktsegment AS segment, o_orderstatus AS status,
         o_orderdate AS placed, CAST(o_orderstatus = 'F' AS INTEGER) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def orders_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: key ``id``, label ``y`` (status F), two numbers, two categories."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        o.o_orderkey.alias("id"), o.o_custkey.alias("cust"), o.o_totalprice.alias("price"),
        c.c_acctbal.alias("balance"), o.o_orderpriority.alias("priority"),
        c.c_mktsegment.alias("segment"), o.o_orderstatus.alias("status"),
        o.o_orderdate.alias("placed"), (o.o_orderstatus == "F").cast("int").alias("y"))


NUMS = ["price", "balance"]
CATS = ["priority", "segment"]

# --- the same with gaps and copies, for audits --------------------------------------------

MESSY = OC + """, messy AS (
  SELECT id, CASE WHEN balance < 0 THEN NULL ELSE price END AS price, balance,
         CASE WHEN segment = 'BUILDING' AND status = 'O' THEN NULL ELSE priority END AS priority,
         segment, CASE WHEN price > 495000 THEN NULL ELSE status END AS status FROM oc
  UNION ALL
  SELECT id, price, balance, priority, segment, status FROM (
    SELECT id, CASE WHEN balance < 0 THEN NULL ELSE price END AS price, balance,
           CASE WHEN segment = 'BUILDING' AND status = 'O' THEN NULL ELSE priority END AS priority,
           segment, CASE WHEN price > 495000 THEN NULL ELSE status END AS status,
           CASE WHEN price > 480000 THEN 2 ELSE 1 END AS copies, price AS true_price FROM oc) AS x
  JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k) AS n ON n.k <= x.copies WHERE x.true_price > 450000)"""


def messy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders with values missing by rule; dear orders occur two or three times."""
    oc = orders_customers(spark, sf_dir)
    copies = F.when(F.col("price") > 480000, 3).when(F.col("price") > 450000, 2).otherwise(1)
    out = oc.withColumn("__k", F.explode(F.sequence(F.lit(1), copies)))
    return out.select(
        "id", F.when(~(F.col("balance") < 0), F.col("price")).alias("price"), "balance",
        F.when(~((F.col("segment") == "BUILDING") & (F.col("status") == "O")), F.col("priority")).alias("priority"),
        "segment", F.when(~(F.col("price") > 495000), F.col("status")).alias("status"))


# --- two versions of the table -----------------------------------------------------------

VERSION_B = OC + """, b AS (
  SELECT id, cust, CASE WHEN priority = '1-URGENT' THEN price + 10 ELSE price END AS price, balance,
         priority, CASE WHEN balance > 9000 THEN 'UNKNOWN' ELSE segment END AS segment,
         CASE WHEN balance < 0 THEN (CASE WHEN status = 'F' THEN 'O' ELSE 'F' END) ELSE status END AS status,
         placed FROM oc WHERE NOT (priority = '5-LOW' AND price < 50000)),
 a2 AS (SELECT *, CASE WHEN status = 'F' THEN 'yes' ELSE 'No ' END AS answer FROM oc),
 b2 AS (SELECT *, CASE WHEN status = 'F' THEN '1' WHEN status = 'P' THEN 'maybe' ELSE '0' END AS answer FROM b)"""


def version_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_customers(spark, sf_dir).withColumn(
        "answer", F.when(F.col("status") == "F", "yes").otherwise("No "))


def version_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some orders gone, urgent prices edited, a new category, labels flipped for debtors."""
    oc = orders_customers(spark, sf_dir).drop("y")
    b = oc.filter(~((F.col("priority") == "5-LOW") & (F.col("price") < 50000)))
    return (b.withColumn("price", F.when(F.col("priority") == "1-URGENT", F.col("price") + 10).otherwise(F.col("price")))
            .withColumn("segment", F.when(F.col("balance") > 9000, "UNKNOWN").otherwise(F.col("segment")))
            .withColumn("status", F.when(F.col("balance") < 0, F.when(F.col("status") == "F", "O").otherwise("F"))
                        .otherwise(F.col("status")))
            .withColumn("answer", F.when(F.col("status") == "F", "1").when(F.col("status") == "P", "maybe").otherwise("0")))


# --- earlier and later orders, for drift ----------------------------------------------------

CUTOFF = "1997-06-01"
SIDES = OC + f""", early AS (SELECT * FROM oc WHERE placed < TIMESTAMP '{CUTOFF} 00:00:00'),
 late AS (SELECT * FROM oc WHERE placed >= TIMESTAMP '{CUTOFF} 00:00:00')"""


def early_late(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    oc = orders_customers(spark, sf_dir)
    cut = F.lit(f"{CUTOFF} 00:00:00").cast("timestamp_ntz")
    return oc.filter(F.col("placed") < cut), oc.filter(F.col("placed") >= cut)


# --- line items -----------------------------------------------------------------------------

LINES = """li AS (
  SELECT l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
         l_linestatus AS linestatus, CAST(month(l_shipdate) AS VARCHAR) AS ship_month,
         CAST(year(l_shipdate) AS VARCHAR) AS ship_year, l_returnflag AS returnflag,
         CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)"""
LINE_NUMS = ["quantity", "price", "discount", "tax"]
LINE_CATS = ["linestatus", "ship_month", "ship_year"]


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_linestatus").alias("linestatus"), F.month("l_shipdate").cast("string").alias("ship_month"),
        F.year("l_shipdate").cast("string").alias("ship_year"), F.col("l_returnflag").alias("returnflag"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"))


# --- labelled documents -----------------------------------------------------------------------

DOCS = """docs AS (
  SELECT d.doc_id, d.n_chars, d.lang, d.source, l.quality, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source").join(
        table(spark, sf_dir, "labels"), "doc_id")


# --- prediction table ---------------------------------------------------------------------------

RISK_TERMS = (("below", "price", 250000, 0.000004), ("slope", "balance", 0.00008),
              ("equals", "priority", "1-URGENT", 0.6), ("equals", "segment", "BUILDING", 0.3))
RISK_INTERCEPT = -1.2
RISK = """1.0 / (1.0 + exp(-(-1.2 + greatest(250000.0 - price, 0.0) * 0.000004 + balance * 0.00008
    + CASE WHEN priority = '1-URGENT' THEN 0.6 ELSE 0.0 END
    + CASE WHEN segment = 'BUILDING' THEN 0.3 ELSE 0.0 END)))"""

PRED = OC + f""", risk AS (SELECT *, round(CAST({RISK} AS DOUBLE), 4) AS p0 FROM oc),
 pred AS (SELECT id, price, balance, priority, segment, CAST(substr(priority, 1, 1) AS INTEGER) AS split,
   CAST(CAST((id * 7919) % 1000 AS DOUBLE) / 1000 < p0 AS INTEGER) AS y, p0 AS p FROM risk)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible score per order and a label that follows it."""
    oc = logistic_risk(orders_customers(spark, sf_dir), RISK_TERMS, RISK_INTERCEPT)
    p = F.round("p", 4)
    draw = ((F.col("id") * 7919) % 1000).cast("double") / 1000
    return oc.select("id", "price", "balance", "priority", "segment",
                     F.substring("priority", 1, 1).cast("int").alias("split"),
                     (draw < p).cast("int").alias("y"), p.alias("p"))


METHODS = PRED + """, preds AS (
  SELECT id, y, split, 'base' AS method, p FROM pred
  UNION ALL SELECT id, y, split, 'sigmoid' AS method, round(1.0 / (1.0 + exp(-(0.1 + 1.1 * ln(p / (1.0 - p))))), 4) AS p FROM pred
  UNION ALL SELECT id, y, split, 'isotonic' AS method, round(p * 0.9, 2) AS p FROM pred)"""


def method_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scores per order: as given, sharpened, and coarse."""
    base = predictions(spark, sf_dir)
    p = F.col("p")
    sharp = F.round(1.0 / (1.0 + F.exp(-(0.1 + 1.1 * F.log(p / (1.0 - p))))), 4)
    variants = F.array(F.struct(F.lit("base").alias("method"), p.alias("p")),
                       F.struct(F.lit("sigmoid").alias("method"), sharp.alias("p")),
                       F.struct(F.lit("isotonic").alias("method"), F.round(p * 0.9, 2).alias("p")))
    return base.select("id", "y", "split", F.inline(variants))


# --- training table with a learnable label -----------------------------------------------------

def training_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).drop("p", "split")
