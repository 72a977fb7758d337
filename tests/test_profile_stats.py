import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import compare, profile, stats


def rows(df, key="feature"):
    return {r[key]: r for r in df.collect()}


def test_numeric_profile(people):
    pdf = people.toPandas()
    got = rows(profile.numeric_profile(people, ["income", "age", "fixed"]))
    for c in ("income", "age", "fixed"):
        x = pdf[c].dropna()
        r = got[c]
        assert (r["count"], r.missing, r.unique_values) == (len(x), pdf[c].isna().sum(), x.nunique())
        assert [r.mean, r.std, r.min, r.q25, r.median, r.q75, r.max] == pytest.approx(
            [x.mean(), x.std(), x.min(), x.quantile(.25), x.median(), x.quantile(.75), x.max()])
        assert (r.zero_count, r.negative_count) == ((x == 0).sum(), (x < 0).sum())


def test_all_null_column(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    r = rows(profile.numeric_profile(df, ["a", "b"]))
    assert r["a"]["count"] == 0 and r["a"].median is None and r["a"].unique_values == 0 and r["b"].median == 1.5


def test_duplicates_of_multiplicity_three(spark):
    df = spark.createDataFrame([(1, "x")] * 3 + [(2, None)] * 2 + [(3, "z")], "id int, t string")
    r = profile.duplicate_audit(df).first()
    assert (r.duplicates_keep_first, r.duplicates_all_members, r.duplicate_groups) == (3, 5, 2)
    s = profile.table_structure(df, "id").first()
    assert (s.rows, s.duplicate_rows, s.duplicate_ids, s.missing_cells) == (6, 3, 3, 2)


def test_categories_keep_nulls(people):
    pdf = people.toPandas()
    got = {(r.feature, r.value): r for r in profile.categorical_profile(people, ["dept", "tag"]).collect()}
    assert got[("dept", None)]["count"] == pdf.dept.isna().sum()
    assert got[("dept", "b")].percent == pytest.approx((pdf.dept == "b").mean() * 100)
    top = profile.categorical_profile(people, ["dept"], top=1).collect()
    assert len(top) == 1 and top[0].value == pdf.dept.value_counts(dropna=False).index[0]
    v = rows(profile.variance_audit(people, ["fixed", "tag", "dept"]))
    assert v["fixed"].constant and v["tag"].near_constant and not v["dept"].near_constant


def test_rate_by_category_and_quantile(people):
    pdf = people.toPandas()
    got = {r.category: r for r in profile.rate_by_category(people, ["dept"], "y").collect()}
    b = pdf[pdf.dept == "b"]
    assert (got["b"].total, got["b"].positives) == (len(b), b.y.sum())
    assert got["b"].deviation_pp == pytest.approx((b.y.mean() - pdf.y.mean()) * 100)
    for c in ("income", "age"):
        bins = pd.qcut(pdf[c], 4, duplicates="drop")
        want = pdf.groupby(bins, observed=True).y.agg(["size", "mean"])
        mine = profile.rate_by_quantile(people, [c], "y", 4).orderBy("bin").collect()
        assert [(r["count"], pytest.approx(r.rate)) for r in mine] == list(want.itertuples(index=False, name=None))
    assert profile.rate_by_quantile(people, ["fixed"], "y").count() == 0


def test_interactions(people):
    pdf = people.toPandas()
    got = {r.interaction_group: r for r in profile.interaction_rates(people, [("age", "tag")], "y").collect()}
    low = pdf[(pdf.age <= pdf.age.median()) & (pdf.tag == "usual")]
    assert got["Low | usual"]["count"] == len(low) and got["Low | usual"].rate == pytest.approx(low.y.mean())


def test_point_biserial(people):
    pdf = people.toPandas().dropna(subset=["income"])
    got = rows(stats.point_biserial(people, ["income", "fixed"], "y"))
    r = np.corrcoef(pdf.income, pdf.y)[0, 1]
    assert got["income"].r == pytest.approx(r)
    assert got["income"].mean_difference == pytest.approx(pdf[pdf.y == 1].income.mean() - pdf[pdf.y == 0].income.mean())
    assert 0 < got["income"].p_value < 1
    assert (got["fixed"].r, got["fixed"].p_value) == (0.0, 1.0)


def test_single_class_target(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(5)], "x double, y int")
    assert stats.point_biserial(df, ["x"], "y").first().r == 0.0
    assert stats.spearman(df, ["x"], "y").first().spearman == 0.0


def test_rank_statistics(people):
    pdf = people.toPandas().dropna(subset=["income"])
    rank = pdf.income.rank()
    assert stats.spearman(people, ["income"], "y").first().spearman == pytest.approx(np.corrcoef(rank, pdf.y)[0, 1])
    a, b = pdf[pdf.y == 0].income.to_numpy(), pdf[pdf.y == 1].income.to_numpy()
    u = sum((x > b).sum() + 0.5 * (x == b).sum() for x in a)
    got = stats.mann_whitney(people, ["income"], "y").first()
    assert got.u_statistic == pytest.approx(u)
    n, ties = len(pdf), pdf.income.value_counts()
    sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - (ties ** 3 - ties).sum() / (n * (n - 1))))
    z = (abs(u - len(a) * len(b) / 2) - 0.5) / sd
    assert got.p_value == pytest.approx(math.erfc(z / math.sqrt(2)))


def chi2(table, yates):
    t = np.asarray(table, float)
    e = np.outer(t.sum(1), t.sum(0)) / t.sum()
    d = np.abs(t - e)
    if yates and t.shape == (2, 2):
        d = d - np.minimum(0.5, d)
    return (d ** 2 / e).sum()


@pytest.mark.parametrize("table", [[[10, 20], [30, 5]], [[8, 0], [3, 9]], [[7, 0], [0, 5]], [[5, 1], [0, 4], [2, 2]], [[3, 4]]])
@pytest.mark.parametrize("yates", [True, False])
def test_chi_square(spark, table, yates):
    data = [(f"r{i}", j) for i, row in enumerate(table) for j, n in enumerate(row) for _ in range(n)]
    got = stats.chi_square_cramers_v(spark.createDataFrame(data, "c string, y int"), ["c"], "y", yates, False).first()
    if len(table) < 2:
        assert (got.chi2, got.cramers_v, got.p_value) == (0.0, 0.0, 1.0)
        return
    want = chi2(table, yates)
    assert got.chi2 == pytest.approx(want)
    assert got.cramers_v == pytest.approx(math.sqrt(want / len(data)))


def test_cramers_bias_correction(people):
    pdf = people.toPandas()
    t = pd.crosstab(pdf.dept, pdf.y)
    n, (r, c) = t.to_numpy().sum(), t.shape
    phi = max(0, chi2(t, True) / n - (c - 1) * (r - 1) / (n - 1))
    want = math.sqrt(phi / min(c - (c - 1) ** 2 / (n - 1) - 1, r - (r - 1) ** 2 / (n - 1) - 1))
    assert stats.chi_square_cramers_v(people, ["dept"], "y").first().cramers_v == pytest.approx(want)


def test_drift(spark, people):
    a, b = people.filter("id < 120"), people.filter("id >= 120")
    pa, pb = a.toPandas(), b.toPandas()
    k = stats.ks_two_sample(a, b, ["income"]).first()
    xa, xb = np.sort(pa.income.dropna()), np.sort(pb.income.dropna())
    grid = np.concatenate([xa, xb])
    want = np.abs(np.searchsorted(xa, grid, "right") / len(xa) - np.searchsorted(xb, grid, "right") / len(xb)).max()
    assert k.ks_statistic == pytest.approx(want)
    assert (k.median_a, k.median_b) == (pytest.approx(np.median(xa)), pytest.approx(np.median(xb)))
    c = rows(stats.categorical_drift(a, b, ["dept", "tag"]))
    share = lambda p: p.dept.fillna("null").value_counts(normalize=True)
    assert c["dept"].total_variation_distance == pytest.approx(0.5 * share(pa).sub(share(pb), fill_value=0).abs().sum())
    one_sided = stats.categorical_drift(spark.createDataFrame([("x",)] * 4, "c string"),
                                        spark.createDataFrame([("z",)] * 4, "c string"), ["c"]).first()
    assert one_sided.total_variation_distance == 1.0 and one_sided.max_proportion_delta == 1.0
    s = stats.smd_drift(a, b, ["age"]).first()
    assert s.smd == pytest.approx((pb.age.mean() - pa.age.mean()) / math.sqrt((pa.age.var(ddof=0) + pb.age.var(ddof=0)) / 2))


def test_mutual_information_of_a_copy_is_entropy(spark):
    df = spark.createDataFrame([(str(i % 2), float(i % 2), i % 2) for i in range(100)], "c string, x double, y int")
    got = rows(stats.mutual_information(df, ["c"], [], "y"))
    assert got["c"].mutual_information == pytest.approx(math.log(2))


def test_ranking_and_redundancy(people):
    df = people.withColumn("twice", F.col("age") * 2.0)
    r = stats.redundancy(df, ["age", "twice", "income"]).filter("feature_a = 'age' AND feature_b = 'twice'").first()
    assert r.level == "very_high" and r.correlation == pytest.approx(1.0)
    ranked = stats.rank_features(people, ["income", "age"], ["dept"], "y").orderBy("rank").collect()
    assert [x["rank"] for x in ranked] == [1, 2, 3]
    assert [x.score for x in ranked] == sorted([x.score for x in ranked], reverse=True)


def test_versions(spark):
    a = spark.createDataFrame([(1, "yes", 1.0, "p"), (2, "no", 2.0, "q"), (3, "no", None, None)], "id int, t string, x double, s string")
    b = spark.createDataFrame([(1, "0", 1.0, "p"), (2, "0", 2.5, None), (4, "1", 9.0, "z")], "id long, t string, x double, s string")
    r = compare.label_disagreement(a, b, "id", "t").first()
    assert (r.shared_rows, r.compared_rows, r.disagreements) == (2, 2, 1)
    d = rows(compare.shared_row_diff(a, b, "id"))
    assert (d["x"].different_values, d["s"].different_values) == (1, 1)
    o = compare.row_overlap(a, b, ["id"]).first()
    assert (o.shared, o.only_a, o.only_b) == (2, 1, 1)
    s = rows(compare.schema_diff(a, b.withColumn("new", F.lit(1))), "column")
    assert s["id"].status == "type_differs" and s["new"].status == "only_in_b" and s["t"].status == "same"
    first = compare.distinct_rows(spark.createDataFrame([(1, 5, "b"), (1, 4, "c"), (2, 1, "a")], "k int, o int, v string"), ["k"], ["o"])
    assert {(x.k, x.o, x.v) for x in first.collect()} == {(1, 4, "c"), (2, 1, "a")}
    u = compare.union_results(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int"))
    assert u.columns == ["a", "b"] and u.count() == 2
