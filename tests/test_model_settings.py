from pyspark.sql import functions as F

from plumbline.operators import importance, models
from plumbline.plans import model_queries as q


def test_registered_settings_are_the_references(spark, monkeypatch):
    assert q.lr().params["maxIter"] == 5000
    assert (q.rf().params["numTrees"], q.rf().params["maxDepth"]) == (400, 30)
    assert models.random_forest("rf", ["x"]).params["maxDepth"] == 30
    assert (q.gb().params["maxIter"], q.gb().params["stepSize"]) == (200, 0.05)
    rows = spark.range(100).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    monkeypatch.setattr(q, "_rows", lambda s, sf: rows)
    assert q._folded(spark, "").select("split").distinct().count() == 25
    seen = []
    monkeypatch.setattr(models, "grid_search", lambda df, spec, options, ids: seen.append(
        (df.select("split").distinct().count(), len(models.grid(spec, options)))) or (None, None))
    for f in (q.h6, q.h6b, q.h6c):
        f(spark, "")
    assert seen == [(10, 18), (10, 432), (10, 192)]
    monkeypatch.setattr(models, "fit", lambda *a, **k: None)
    monkeypatch.setattr(importance, "permutation_importance", lambda *a, repeats: seen.append(repeats))
    monkeypatch.setattr(importance, "subset_evaluation", lambda df, specs, sizes, ids: seen.append(sizes))
    q.h16(spark, "")
    q.h17(spark, "")
    assert seen[3:] == [10, [1, 2, 3, 4]]


def test_grid_varies_class_weights_and_feature_sampling(spark, monkeypatch):
    spec = models.random_forest("rf", ["x"], trees=2, depth=2, min_leaf=1)
    found = models.grid(spec, {"featureSubsetStrategy": ["sqrt", "log2"], "balanced": [False, True]})
    assert [(c.params["featureSubsetStrategy"], c.balanced) for c in found] == [
        ("sqrt", False), ("sqrt", True), ("log2", False), ("log2", True)]
    assert all("balanced" not in c.params for c in found) and len({c.name for c in found}) == 4
    rows = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("y"),
                                  F.lit(0).alias("repeat"), (F.col("id") % 2).cast("int").alias("fold"))
    monkeypatch.setattr(models, "CANDIDATES_AT_ONCE", 3)
    out = models.evaluate_candidates(rows.withColumn("split", F.col("fold")), found, ["id"]).collect()
    assert sorted(r.model for r in out) == sorted(c.name for c in found) and {r.splits for r in out} == {2}
