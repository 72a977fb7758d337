"""Splits, preparation, models, calibration, importance and scoring: invariants on a learnable table."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from plumbline.operators import calibrate, features, importance, metrics, models, splits
from plumbline.streaming import scoring

IDS = ["id"]


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(11)
    rows = []
    for i in range(400):
        x, z, c = r.gauss(0, 1), r.gauss(0, 1), r.choice("abc")
        y = int(r.random() < 1 / (1 + math.exp(-(1.5 * x + (c == "a") * 1.0 - 0.8))))
        rows.append((i, x if i % 17 else None, z, c if i % 19 else None, y))
    return spark.createDataFrame(rows, "id long, x double, z double, c string, y int").repartition(4).cache()


def spec(**kw):
    return models.logistic("lr", ["x", "z"], ["c"], maxIter=30, **kw)


def test_folds_are_exact_and_disjoint(data):
    f = splits.repeated_stratified_kfold(data, "y", IDS, 5, (42, 52)).select("id", "y", "repeat", "fold", "split").toPandas()
    assert len(f) == 800 and not f.duplicated(["id", "repeat"]).any()
    sizes = f.groupby(["repeat", "y", "fold"]).size().unstack()
    assert ((sizes.max(axis=1) - sizes.min(axis=1)) <= 1).all()
    assert sorted(f.split.unique()) == list(range(10))
    a, b = (f[f.repeat == r].set_index("id").fold.sort_index() for r in (0, 1))
    assert (a != b).mean() > 0.5
    again = splits.repeated_stratified_kfold(data.repartition(3), "y", IDS, 5, (42, 52)).toPandas()
    assert (again.set_index(["id", "repeat"]).fold.sort_index() == f.set_index(["id", "repeat"]).fold.sort_index()).all()


def test_tiny_classes_and_holdouts(spark, data):
    tiny = spark.createDataFrame([(i, int(i < 2)) for i in range(12)], "id long, y int")
    f = splits.stratified_kfold(tiny, "y", IDS, 5).toPandas()
    assert f.groupby(["y", "fold"]).size().max() <= 3 and len(f) == 12
    h = splits.stratified_holdout(data, "y", IDS, 0.2).toPandas()
    for y, n in data.toPandas().y.value_counts().items():
        assert h[h.y == y].is_holdout.sum() == math.floor(n * 0.2 + 0.5)
    r = splits.repeated_holdout(data, "y", IDS, 4, 0.25).toPandas()
    assert r.groupby("split").is_holdout.sum().nunique() == 1 and len(r) == 1600


def test_preparation(data):
    pdf = data.toPandas()
    model = features.fit_preprocessor(data, ["x", "z"], ["c"])
    out = model.transform(data).select("id", vector_to_array("features").alias("v")).toPandas().sort_values("id")
    v = np.array(out.v.tolist())
    x = pdf.sort_values("id").x
    filled = x.fillna(x.median())
    assert np.allclose(v[:, 0], (filled - filled.mean()) / filled.std(ddof=0))
    assert np.allclose(v[:, 1].std(), 1) and set(v[:, 2:].sum(axis=1)) == {1.0}
    assert [n for n, _ in features.encoded_names(model)] == ["x", "z", "c=a", "c=b", "c=c"]
    unseen = model.transform(data.limit(3).withColumn("c", F.lit("never"))).select(vector_to_array("features").alias("v")).collect()
    assert all(r.v[2:] == [0.0, 0.0, 0.0] for r in unseen)


def test_fill_and_scale(spark):
    df = spark.createDataFrame([(1.0, "b", 2.0), (None, "a", 2.0), (3.0, "b", 2.0), (8.0, None, 2.0), (None, "a", 2.0)], "x double, c string, k double")
    assert [r.x for r in features.apply_fill(df, features.impute_median(df, ["x"]), ["x"]).collect()] == [1.0, 3.0, 3.0, 8.0, 3.0]
    assert [r.c for r in features.apply_fill(df, features.impute_mode(df, ["c"]), ["c"]).collect()] == ["b", "a", "b", "a", "a"]
    assert {r.k for r in features.scale(df, features.scale_stats(df, ["k"]), ["k"]).collect()} == {0.0}


@pytest.fixture(scope="module")
def fitted(data):
    return models.fit(spec(), data)


def test_scoring_contract(spark, data, fitted, tmp_path_factory):
    feats = spec().features
    out = models.score(data.withColumn("extra", F.lit("ignored")), fitted, 0.25, feats).toPandas()
    assert out.p.between(0, 1).all() and (out.flag == (out.p >= 0.25)).all() and "extra" in out
    with pytest.raises(ValueError, match="missing columns"):
        models.score(data.drop("z"), fitted, 0.25, feats)
    strange = models.score(data.withColumn("c", F.lit("never seen")), fitted, 0.25, feats)
    assert strange.filter(F.col("p").isNull()).count() == 0
    text = models.score(data.withColumn("x", F.lit("not a number")), fitted, 0.25, feats)
    assert text.count() == 400  # unreadable numbers are imputed like missing ones
    root = tmp_path_factory.mktemp("scoring")
    data.write.option("header", True).csv(f"{root}/in.csv")
    assert models.score_files(spark, fitted, f"{root}/in.csv", f"{root}/out.csv", feats, 0.25).count() == 400
    data.write.parquet(f"{root}/stream")
    stream = scoring.score_stream(spark, fitted, f"{root}/stream", data.schema, feats, 0.25)
    scoring.write_stream(stream, f"{root}/scored", f"{root}/state").awaitTermination()
    batch = models.score(data, fitted, 0.25).select("id", "p")
    assert spark.read.parquet(f"{root}/scored").select("id", "p").exceptAll(batch).count() == 0


def test_information(fitted):
    c = models.coefficients(fitted)
    agg = {r.feature: r for r in models.aggregate_coefficients(c).collect()}
    assert agg["c"].encoded_columns == 3 and agg["x"].coefficient_mean > abs(agg["z"].coefficient_mean)
    assert models.feature_importance(fitted).first().feature in ("x", "c")
    assert models.model_information(fitted).first().encoded_features == 5


def test_cross_validation_and_oof(data):
    folds = splits.repeated_stratified_kfold(data, "y", IDS, 3, (1,))
    pred = models.oof_pooled(folds, [spec()], IDS)
    assert pred.count() == 400 and models.rows_without_prediction(data, pred, IDS).count() == 0
    mean = models.oof_mean(pred.unionByName(pred.withColumn("p", F.col("p") * 0)), IDS)
    assert mean.filter("predictions <> 2").count() == 0
    assert metrics.ranking_metrics(pred).first().roc_auc > 0.7
    ranked, best = models.grid_search(folds, spec(), {"C": [1e-4, 1.0]}, IDS)
    assert best.params["C"] in (1e-4, 1.0) and ranked.count() == 2


def test_majority(spark):
    train = spark.createDataFrame([(0,), (0,), (1,)], "y int")
    r = models.majority_baseline(train, spark.createDataFrame([(1,), (0,)], "y int")).first()
    assert (r.majority, r.tn, r.fn, r.recall, r.accuracy) == (0, 1, 1, 0.0, 0.5)


def test_forest_gbt_and_production(data, tmp_path):
    train, test = data.filter("id % 4 <> 0"), data.filter("id % 4 = 0")
    kinds = [models.random_forest("rf", ["x", "z"], ["c"], trees=10, depth=5, min_leaf=5), models.gbt("gb", ["x", "z"], ["c"], iterations=5)]
    got = models.holdout_evaluate(train, test, kinds).collect()
    assert {r.model for r in got} == {"rf", "gb"} and all(r.roc_auc > 0.6 for r in got)
    meta = models.fit_production(data, kinds[0], f"{tmp_path}/m", 0.25, 3, IDS).first()
    assert meta.features == ["x", "z", "c"] and meta.training_rows == 400
    again = calibrate.CalibratedModel.load(f"{tmp_path}/m")
    p = models.score(data, again, 0.25, meta.features).toPandas()
    assert len(again.members) == 3 and p.p.between(0, 1).all()
    assert abs(p.p.mean() - p.y.mean()) < 0.08


def test_calibrators(spark):
    r = random.Random(5)
    rows = [(int(r.random() < q), q ** 2) for q in (r.choice([0.1, 0.3, 0.5, 0.7, 0.9]) for _ in range(2000))]
    df = spark.createDataFrame(rows, "y int, p double")
    platt = calibrate.apply_platt(df, calibrate.fit_platt(df), out="q")
    assert metrics.ece(platt, score="q").first()[0] < metrics.ece(df).first()[0]
    iso = calibrate.apply_isotonic(df, calibrate.fit_isotonic(df), out="q").select("p", "q").distinct().orderBy("p").collect()
    q = [x.q for x in iso]
    assert q == sorted(q) and all(0 <= v <= 1 for v in q)
    perf = spark.createDataFrame([("base", .25, .7, .1, .7), ("s", .2, .6, .05, .69), ("i", .21, .58, .2, .7)],
                                 "method string, brier_score double, log_loss double, expected_calibration_error double, roc_auc double")
    c = calibrate.choose_calibration(perf, "base", ["s", "i"]).first()
    assert c.selected_method == "i" and c.status.endswith("PARTIAL") and c.ranking_preserved


def test_permutation(data, fitted):
    v = importance.permuted_variants(data, ["x"], IDS, 2, buckets=50).toPandas()
    one = importance.permuted_variants(data, ["x"], IDS, 2, buckets=1).toPandas()
    order = ["repeat", "id"]
    assert v.sort_values(order).x.fillna(-9).tolist() == one.sort_values(order).x.fillna(-9).tolist()
    base = data.toPandas().set_index("id").x.sort_index()
    for _, g in v.groupby("repeat"):
        moved = g.set_index("id").x.sort_index()
        assert sorted(moved.fillna(-9)) == sorted(base.fillna(-9))
        assert (moved.fillna(-9) != base.fillna(-9)).mean() > 0.9
    got = {r.feature: r.importance_mean for r in importance.permutation_importance(data, fitted, ["x", "z"], IDS, 2).collect()}
    assert got["x"] > 0.1 > abs(got["z"])


def test_selection_and_stability(spark):
    imp = spark.createDataFrame([(s, "m", f, v) for s in (1, 2) for f, v in (("a", .4), ("b", .3), ("c", .2), ("d", .1), ("e", -.1 if s == 1 else .05))],
                                "split int, model string, feature string, importance_mean double")
    sel = importance.select_features(imp, keys=["split"])
    assert {(r.split, r.feature) for r in sel.collect()} == {(s, f) for s in (1, 2) for f in "abc"}
    none = spark.createDataFrame([("a", -1.0), ("b", -2.0), ("c", -3.0), ("d", -4.0)], "feature string, importance_mean double")
    assert {r.feature for r in importance.select_features(none).collect()} == {"a", "b", "c"}
    assert [r.feature for r in importance.top_features(none, 2).orderBy("rank").collect()] == ["a", "b"]
    s = {r.feature: r for r in importance.stability_score(imp, sel, imp.withColumnRenamed("importance_mean", "coefficient")).collect()}
    assert s["a"].stability_score == pytest.approx(1.0) and s["a"].stability_class == "stable"
    assert s["e"].stability_class == "weak" and s["e"].positive_importance_frequency == 0.5
    freq = importance.selection_frequency(spark.createDataFrame([(2, "a|b"), (2, "a|c")], "subset_size int, features string"))
    assert {r.feature: r.selection_frequency for r in freq.collect()} == {"a": 1.0, "b": 0.5, "c": 0.5}


def test_subsets_rank_on_training_rows(data):
    folds = splits.repeated_stratified_kfold(data, "y", IDS, 3, (1,))
    got = importance.subset_evaluation(folds, [spec()], [1, 3], IDS).collect()
    assert len(got) == 6 and {r.features for r in got if r.subset_size == 1} <= {"x", "c"}


def test_calibration_is_fitted_on_raw_probabilities(spark):
    import math
    from plumbline.operators import calibrate
    rows = [(float(i % 10) / 10, int((i * 7) % 10 < i % 10)) for i in range(400)]
    df = spark.createDataFrame(rows, "p double, y int")
    model = calibrate.fit_platt(df, smooth=True, raw=True)
    n1 = sum(y for _, y in rows)
    high, low = (n1 + 1) / (n1 + 2), 1 / (len(rows) - n1 + 2)
    a, b = float(model.coefficients[0]), float(model.intercept)
    # At the optimum both score equations over the raw probability vanish.
    rest = [(1 / (1 + math.exp(-(a * p + b))) - (high if y else low), p) for p, y in rows]
    assert abs(sum(r for r, _ in rest)) < 1e-2 and abs(sum(r * p for r, p in rest)) < 1e-2
