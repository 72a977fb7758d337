"""Trees of all splits from one table of cells: rows are encoded once, models grow in tasks of their own, equal forests grow once."""

import random

import numpy as np
import pytest

from plumbline.operators import batched, forest, metrics, models, splits


@pytest.fixture(scope="module")
def folded(spark):
    """150 rows with gaps in a number and a category, on 2 folds x 1 repeat."""
    r = random.Random(8)
    rows = [(i, r.choice([None, 1.0, 2.0, 4.0, 7.0]), r.choice(["u", "v", None]), int(r.random() < 0.3 + 0.4 * (i % 5 == 0))) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, x double, c string, y int")
    return splits.repeated_stratified_kfold(df, "y", ["id"], 2, (1,)).cache()


def test_families_share_one_encoding(folded, monkeypatch):
    specs = [models.logistic("lr", ["x"], ["c"]), models.random_forest("rf", ["x"], ["c"], trees=3, depth=3, min_leaf=2),
             *[models.gbt(f"gb{n}", ["x"], ["c"], iterations=n, depth=2, min_leaf=2) for n in (1, 2)]]
    seen, plain = [], batched.encode
    monkeypatch.setattr(batched, "encode", lambda *a, **k: seen.append(a) or plain(*a, **k))
    found = models.compare_families(folded, specs, ["id"]).collect()
    assert {r["model"]: r["splits"] for r in found} == {"lr": 2, "rf": 2, "gb1": 2, "gb2": 2}
    assert len(seen) == 1


def test_trees_grown_together_are_those_grown_alone():
    r = np.random.default_rng(4)
    q = np.indices([9, 3]).reshape(2, -1).T.astype(np.int16)
    columns = [(0, -1), (1, 0), (1, 1), (1, 2)]
    ns = [r.poisson(3, (27, 2)), np.zeros((27, 2), int), r.poisson(5, (27, 2)), np.eye(27, 2, dtype=int)]
    alone = [forest.grow(q, [9, 3], columns, n, (1.3, 0.8), 2, 2, [0, 2, 30], np.random.default_rng(t)) for t, n in enumerate(ns)]
    out, gains = forest.grow_together(q, [9, 3], columns, ns, (1.3, 0.8), 2, 2, [0, 2, 30], [np.random.default_rng(t) for t in range(4)])
    assert all(np.array_equal(a, p) and np.array_equal(g, s) for (a, g), p, s in zip(alone, out, gains))
    many = forest.grow(q, [9, 3], columns, ns[0] * (1 << 22), (1.0, 1.0), 4, 1 << 23, [3], r)[0]  # too many rows for two counts in one number
    assert np.allclose(many, forest.grow(q, [9, 3], columns, ns[0], (1.0, 1.0), 4, 2, [3], r)[0])
    numbers = r.random((600, 5), np.float32)
    assert np.array_equal(forest._drawn(numbers, 2), np.hstack([forest._drawn(numbers[:300], 2), forest._drawn(numbers[300:], 2)]))


def test_equal_forests_grow_once(folded, monkeypatch):
    specs = [models.random_forest(s, ["x"], ["c"], trees=4, depth=3, min_leaf=2, featureSubsetStrategy=s) for s in ("2", "sqrt", "all")]
    grown, plain = [], forest._grown
    monkeypatch.setattr(forest, "_grown", lambda *a: grown.append(len(a[5])) or plain(*a))
    found = {(r["model"], r["split"]): (r["roc_auc"], r["pr_auc"]) for r in models.split_ranking(folded, specs, ["id"]).collect()}
    assert len(found) == 6 and all(found["2", s] == found["sqrt", s] for s in (0, 1))
    assert grown == [4]  # two configurations on two splits


def test_boosting_takes_no_job_per_level(folded, monkeypatch):
    """Samples of the rows included, whatever the number of iterations whose samples are sent at once."""
    specs = [models.gbt(f"g{n}-{rate}", ["x"], ["c"], iterations=n, rate=0.3, depth=2, min_leaf=2, subsample=rate) for n, rate in (
        (1, 1.0), (3, 1.0), (2, 0.6), (3, 0.8))]
    rows = metrics.ranking_metrics(models.oof_pooled(folded, specs, ["id"]), ["model", "split"]).collect()
    plain = {(r["model"], r["split"]): (r["roc_auc"], r["pr_auc"]) for r in rows}
    monkeypatch.setattr(batched, "_boost", None)
    monkeypatch.setattr(batched, "DRAWN_BYTES", 1)
    found = {(r["model"], r["split"]): (r["roc_auc"], r["pr_auc"]) for r in models.split_ranking(folded, specs, ["id"]).collect()}
    assert found.keys() == plain.keys() and all(np.allclose(found[k], plain[k]) for k in plain)
