"""Ranking of logistic scores in ranges, against the ranking of their rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import batched, importance, metrics, models, splits


@pytest.fixture(scope="module")
def encoded(spark):
    """200 rows on 2 folds x 2 repeats: one model has a score per row, another four scores in all."""
    r = random.Random(8)
    rows = [(i, r.gauss(0, 1), r.choice("uvwx"), int(r.random() < 0.4)) for i in range(200)]
    df = splits.repeated_stratified_kfold(spark.createDataFrame(rows, "id long, a double, c string, y int"), "y", ["id"], 2, (1, 2)).cache()
    e = batched.encode(df, ["a"], ["c"], ["id"])
    jobs = [batched.LogisticJob(name, s, nums, ["c"], 1.0, False) for s in e.splits.values() for name, nums in (("fine", ["a"]), ("coarse", []))]
    batched.fit_logistic(e, jobs)
    return df, e, jobs


@pytest.mark.parametrize("held", [True, False])
@pytest.mark.parametrize("together,at_once,gathered,bits", [(1 << 21, 1 << 27, 1 << 22, 44), (16, 250, 64, 60), (1, 1, 1, 50)])
def test_ranges_give_the_metrics_of_all_rows(encoded, monkeypatch, held, together, at_once, gathered, bits):
    _, e, jobs = encoded
    for name, value in (("SCORES_TOGETHER", together), ("SCORES_AT_ONCE", at_once), ("SCORES_HELD", gathered), ("SCORE_BITS", bits)):
        monkeypatch.setattr(batched, name, value)
    rows = metrics.ranking_metrics(batched.predict_logistic(e, jobs, held).withColumn("p", F.round("p", 12)), ["model", "split"])
    wanted = {(r["model"], r["split"]): r for r in rows.collect()}
    found = {(r["model"], r["split"]): r for r in batched.rank_logistic(e, jobs, held).collect()}
    assert set(found) == set(wanted) and len(found) == 8
    for key, r in found.items():
        assert r["roc_auc"] == pytest.approx(wanted[key]["roc_auc"], abs=1e-12)
        assert r["pr_auc"] == pytest.approx(wanted[key]["pr_auc"], abs=1e-12)


def test_one_label_and_repeated_names(spark):
    """Without positives there is no AUC; models of one name and split are ranked together."""
    df = spark.createDataFrame([(i, float(i), 0, 0, i % 2, i % 2) for i in range(8)], "id long, a double, y int, repeat int, fold int, split int")
    e = batched.encode(df, ["a"], [], ["id"])
    jobs = [batched.LogisticJob("m", s, ["a"], [], 1.0, False) for s in e.splits.values() for _ in range(2)]
    for j in jobs:
        j.base = np.zeros(e.width)
    assert sorted(tuple(r) for r in batched.rank_logistic(e, jobs).collect()) == [("m", 0, None, 0.0), ("m", 1, None, 0.0)]


def test_searches_write_no_predictions(encoded, monkeypatch):
    """A search with training scores and the subsets rank scores without a table of predictions."""
    df, _, _ = encoded

    def refuse(*_):
        raise AssertionError("predictions were written")

    monkeypatch.setattr(batched, "predict_logistic", refuse)
    spec = models.logistic("l", ["a"], ["c"], balanced=False)
    out = models.evaluate_candidates(df, models.grid(spec, {"C": [0.1, 1.0]}), ["id"], train_scores=True).collect()
    assert len(out) == 2 and all(0 <= r["train_roc_auc_mean"] <= 1 and r["splits"] == 4 for r in out)
    subsets = importance.subset_evaluation(df, [spec], [1, 2], ["id"]).collect()
    assert len(subsets) == 8 and all(r["features"].count("|") == r["subset_size"] - 1 for r in subsets)


def test_scores_with_gaps_are_ranked_as_rows(spark, monkeypatch):
    """A table of numbered scores with ties, gaps and a number without positives."""
    monkeypatch.setattr(batched, "SCORES_TOGETHER", 8)
    monkeypatch.setattr(batched, "SCORES_HELD", 16)
    r = random.Random(4)
    rows = [(n, r.choice([0, 1, None]) if n else 0, r.choice([None, float("nan"), 0.0, 0.25, 0.5, 1.0, r.random()])) for n in range(3) for _ in range(60)]
    pred = spark.createDataFrame(rows, "n int, y int, p double")
    wanted = {r["model"]: r for r in metrics.ranking_metrics(pred.withColumnRenamed("n", "model"), ["model"]).collect()}
    found = batched.rank_scores(pred, [60] * 3)
    assert set(found) == set(wanted) and found[0] == (None, 0.0)
    for n in (1, 2):
        assert found[n] == pytest.approx((wanted[n]["roc_auc"], wanted[n]["pr_auc"]), abs=1e-12)


def test_importance_ranks_no_rows(spark, monkeypatch):
    """Permuted copies are ranked as numbers, not as rows."""
    def refuse(*_):
        raise AssertionError("rows were ranked")

    monkeypatch.setattr(importance, "ranking_metrics", refuse)
    r = random.Random(6)
    df = spark.createDataFrame([(i, x, r.random(), int(r.random() < x)) for i, x in ((i, r.random()) for i in range(300))], "id long, a double, b double, y int")
    spec = models.logistic("l", ["a", "b"])
    found = {r["feature"]: r for r in importance.permutation_importance(df, models.fit(spec, df), ["a", "b"], ["id"], 2).collect()}
    assert set(found) == {"a", "b"} and found["a"]["importance_mean"] > 0.1 > abs(found["b"]["importance_mean"])
