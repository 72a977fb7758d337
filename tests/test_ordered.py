"""Exact ranks and quantiles against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.columns import decision_tree_index
from plumbline.functions.ordered import column_quantiles, order_statistics, quantiles, running_totals, with_value_bucket


def test_value_bucket_is_monotone(spark):
    values = [-math.inf, -1e300, -5.0, -4.999, -1e-300, 0.0, 5e-324, 1e-310, 0.1, 0.3, 0.30000000000000004,
              0.49999999999999994, 0.5, 1.0, 1.9999999999999998, 2.0, 1e300, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.b for r in with_value_bucket(df, "v", "b").orderBy("v").collect()]
    assert got == sorted(got)
    assert got[0] < got[2] and got[-1] > got[-3]


@pytest.mark.parametrize("probs", [[0.0, 0.25, 0.5, 0.9, 1.0], [0.333]])
def test_quantiles_match_numpy(spark, people, probs):
    pdf = people.toPandas()
    got = {r.feature: (r.n, r.q) for r in column_quantiles(people, ["income", "age", "fixed"], probs).collect()}
    for c in ("income", "age", "fixed"):
        x = pdf[c].dropna().to_numpy(dtype=float)
        assert got[c][0] == len(x)
        assert np.allclose(got[c][1], np.quantile(x, probs))


def test_quantiles_by_key_with_null_key_and_single_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 7.0), (None, None), ("b", None)], "k string, v double")
    got = {r.k: r.q for r in quantiles(df, "v", [0.5], ["k"]).collect()}
    assert got == {"a": [2.0], None: [7.0]}


def test_hot_value_and_order_statistics(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, 4.0).otherwise(F.col("id").cast("double")).alias("v"))
    ranks = F.array(*[F.lit(r).cast("long") for r in (0, 350, 699, 700, 999, 5000)])
    got = {r["rank"]: r["v"] for r in order_statistics(df, "v", ranks).collect()}
    assert got == {0: 4.0, 350: 4.0, 699: 4.0, 700: 700.0, 999: 999.0}


def test_running_totals(spark, scores):
    pdf = scores.toPandas()
    got = running_totals(scores, "p", {"pos": F.col("y"), "n": F.lit(1)}, ["method"]).collect()
    assert len(got) == pdf.groupby(["method", "p"]).ngroups
    for r in got:
        mine = pdf[pdf.method == r.method]
        below = mine[mine.p < r.p]
        assert (r.n, r.pos) == ((mine.p == r.p).sum(), mine[mine.p == r.p].y.sum())
        assert (r.n_before, r.pos_before, r.n_total, r.pos_total) == (len(below), below.y.sum(), len(mine), mine.y.sum())


def test_decision_tree_index(spark):
    edges = [0.1, 0.2, 0.3, 0.30000000000000004, 0.9]
    df = spark.createDataFrame([(x,) for x in [0.0, 0.1, 0.15, 0.3, 0.30000000000000004, 0.9, 2.0]], "p double")
    for r in df.select("p", decision_tree_index("p", edges).alias("a"),
                       decision_tree_index("p", edges, inclusive=False).alias("b")).collect():
        assert r.a == sum(e <= r.p for e in edges)
        assert r.b == sum(e < r.p for e in edges)
