"""Forests and boosted trees over cells, against plain trees and Spark's trees on rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import batched, calibrate, forest, models, splits


@pytest.fixture(scope="module")
def rows(spark):
    """600 rows with seven values of a number and three levels, some missing."""
    r = random.Random(3)
    data = []
    for i in range(600):
        x, c = r.choice([1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0]), r.choice("uvw")
        data.append((i, None if i % 29 == 0 else x, None if i % 31 == 0 else c, int(r.random() < 0.1 + 0.03 * x + 0.2 * (c == "v"))))
    return spark.createDataFrame(data, "id long, x double, c string, y int").cache()


def plain_tree(q, n, columns, leaf, depth):
    """Probability per cell of the tree with the best Gini split of every node, all columns allowed."""
    p = np.zeros(len(q))

    def walk(here, left):
        a, b = n[here].sum(axis=0)
        p[here] = b / (a + b)
        best = ((a * a + b * b) / (a + b) + 1e-9, None)
        for f, v in columns if left else []:
            for cut in range(q[:, f].max()) if v < 0 else [v]:
                side = here & (q[:, f] > cut if v < 0 else q[:, f] == cut)
                rest = here & ~side
                if min(n[side].sum(), n[rest].sum()) < leaf:
                    continue
                value = sum((n[s].sum(axis=0) ** 2).sum() / n[s].sum() for s in (side, rest))
                if value > best[0] + 1e-9:
                    best = (value, (side, rest))
        for part in best[1] or ():
            walk(part, left - 1)

    walk(np.ones(len(q), bool), depth)
    return p


def test_a_tree_on_counts_is_the_plain_one():
    r = np.random.default_rng(2)
    q = np.indices([6, 4]).reshape(2, -1).T.astype(np.int16)
    n = r.poisson(9, (24, 2)) + np.stack([q[:, 0], 5 - q[:, 0]], 1)
    n[3] = 0  # a cell that no row is in still has a score
    columns = [(0, -1), (1, 0), (1, 1), (1, 2), (1, 3)]
    out, gains = forest.grow(q, [6, 4], columns, n, (1.0, 1.0), 5, 8, [0, 1, 3], r)
    for p, depth in zip(out, (0, 1, 3)):
        assert np.allclose(p, plain_tree(q, n, columns, 8, depth))
    assert gains[0] > 0 and (gains >= 0).all()
    twice, _ = forest.grow(q, [6, 4], columns, n, (2.0, 1.0), 5, 8, [0], r)
    assert twice[0][0] == pytest.approx(n[:, 1].sum() / (n[:, 1].sum() + 2 * n[:, 0].sum()))
    assert [forest.subset_size(s, 12, 9) for s in ("sqrt", "log2", "0.7", "all", "auto", "3", "onethird")] == [4, 4, 9, 12, 4, 3, 4]


def test_forest_of_cells_is_saved_and_scored(spark, rows, monkeypatch, tmp_path):
    spec = models.random_forest("rf", ["x"], ["c"], trees=30, depth=4, min_leaf=3)
    by_rows = models.feature_importance(models.fit(spec, rows)).collect()
    monkeypatch.setattr(models, "ROWS_FOR_TREES", 10)
    model = models.fit(spec, rows)
    assert isinstance(model.stages[-1], forest.RandomForestClassificationModel)
    by_cells = models.feature_importance(model).collect()
    assert [(r.model_type, r.feature) for r in by_cells] == [(r.model_type, r.feature) for r in by_rows]
    assert [r.importance for r in by_cells] == pytest.approx([r.importance for r in by_rows], abs=0.12)
    strange = rows.withColumn("c", F.when(F.col("id") % 2 == 0, "never seen").otherwise(F.col("c")))
    p = {r.id: r.p for r in models.score(strange, model).collect()}
    kept = calibrate.CalibratedModel([(model, 1.0, 0.0)])
    kept.save(f"{tmp_path}/m")
    again = calibrate.CalibratedModel.load(f"{tmp_path}/m").members[0][0]
    assert {r.id: r.p for r in models.score(strange, again).collect()} == p and all(0 <= v <= 1 for v in p.values())
    same = models.score(rows, model).groupBy("x", "c").agg(F.count_distinct("p").alias("n"), F.avg("y").alias("y"), F.max("p").alias("p"), F.count("*").alias("rows"))
    assert all(r.n == 1 and (r.rows < 15 or abs(r.y - r.p) < 0.25) for r in same.collect())


def test_boosted_trees_of_cells_are_those_of_the_rows(rows, monkeypatch):
    spec = models.gbt("gb", ["x"], ["c"], iterations=4, rate=0.3, depth=3, min_leaf=20)
    plain = models.fit(spec, rows)
    monkeypatch.setattr(models, "ROWS_FOR_TREES", 10)
    model = models.fit(spec, rows)
    assert "x__bin" in model.transform(rows).columns and "x__bin" not in plain.transform(rows).columns
    p, q = ([r.p for r in models.score(rows, m).orderBy("id").collect()] for m in (plain, model))
    assert np.allclose(p, q)
    assert models.model_information(model).collect() == models.model_information(plain).collect()


def test_forests_of_all_splits(rows, monkeypatch):
    folded = splits.repeated_stratified_kfold(rows, "y", ["id"], 3, (1,))
    specs = [models.random_forest(f"f{n}-{d}", ["x"], ["c"], trees=n, depth=d, min_leaf=2) for n in (4, 8) for d in (0, 3)]
    specs.append(models.random_forest("again", ["x"], ["c"], trees=8, depth=3, min_leaf=2))
    got = {(r.model, r.split): (r.roc_auc, r.pr_auc) for r in models.split_ranking(folded, specs, ["id"]).collect()}
    assert len(got) == 15 and all(got["again", s] == got["f8-3", s] for s in range(3))
    assert all(got["f4-0", s][0] == 0.5 and got["f8-3", s][0] > 0.6 for s in range(3))
    monkeypatch.setattr(batched, "MOST_CELLS", 2)  # Spark's forests then
    assert models.split_ranking(folded, specs[3:4], ["id"]).count() == 3
