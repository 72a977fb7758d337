import numpy as np
import pytest

from plumbline.operators import metrics, rules


def brute(y, p, t):
    hit = p >= t
    return {"tp": (hit & (y == 1)).sum(), "fp": (hit & (y == 0)).sum(), "tn": (~hit & (y == 0)).sum(), "fn": (~hit & (y == 1)).sum()}


def test_sweep_equals_single_thresholds(scores):
    pdf = scores.toPandas()
    grid = [0.05, 0.3, 0.6, 0.7, 0.95, 1.0]
    got = {(r.method, r.threshold): r for r in metrics.threshold_sweep(scores, grid, ["method"]).collect()}
    assert len(got) == 12
    for (m, t), r in got.items():
        mine = pdf[pdf.method == m]
        want = brute(mine.y.to_numpy(), mine.p.to_numpy(), t)
        assert {k: r[k] for k in want} == want
        tp, fp, tn, fn = (want[k] for k in ("tp", "fp", "tn", "fn"))
        assert r.precision == pytest.approx(tp / (tp + fp) if tp + fp else 0)
        assert r.balanced_accuracy == pytest.approx((tp / (tp + fn) + tn / (tn + fp)) / 2)
        assert r.flagged_per_1000 == pytest.approx(1000 * (tp + fp) / len(mine))
    one = metrics.threshold_metrics(scores, 0.6, ["method"]).filter("method = 'm1'").first()
    assert one.f1 == pytest.approx(got[("m1", 0.6)].f1)


def test_nothing_predicted_positive_and_single_class(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, p double")
    r = metrics.threshold_metrics(df, 0.9).first()
    assert (r.precision, r.recall, r.f1, r.specificity, r.balanced_accuracy) == (0, 0, 0, 1, 1)
    k = metrics.ranking_metrics(df).first()
    assert k.roc_auc is None and k.pr_auc == 0


def test_ranking(scores):
    pdf = scores.toPandas()
    for r in metrics.ranking_metrics(scores, ["method"]).collect():
        mine = pdf[pdf.method == r.method]
        pos, neg = mine[mine.y == 1].p.to_numpy(), mine[mine.y == 0].p.to_numpy()
        auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert r.roc_auc == pytest.approx(auc)
        ap, prev = 0.0, 0.0
        for t in sorted(mine.p.unique(), reverse=True):
            hit = mine[mine.p >= t]
            rec = hit.y.sum() / len(pos)
            ap, prev = ap + (rec - prev) * hit.y.mean(), rec
        assert r.pr_auc == pytest.approx(ap)


def test_probability_metrics_and_bins(scores):
    pdf = scores.toPandas()
    y, p = pdf.y.to_numpy(), pdf.p.to_numpy()
    r = metrics.probability_metrics(scores, eps=1e-6).first()
    q = np.clip(p, 1e-6, 1 - 1e-6)
    assert r.brier_score == pytest.approx(((p - y) ** 2).mean())
    assert r.log_loss == pytest.approx(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())
    edges = np.linspace(0, 1, 11)
    assert metrics.linspace_edges(10) == list(edges)
    bins = metrics.calibration_bins(scores).orderBy("bin").collect()
    total = 0.0
    for i, b in enumerate(bins):
        mask = (p >= edges[i]) & ((p <= edges[i + 1]) if i == 9 else (p < edges[i + 1]))
        assert b["count"] == mask.sum()
        if mask.any():
            assert b.absolute_error == pytest.approx(abs(p[mask].mean() - y[mask].mean()))
            total += mask.sum() * abs(p[mask].mean() - y[mask].mean())
    assert metrics.ece(scores).first().expected_calibration_error == pytest.approx(total / len(p))


def test_empty_bins_and_bands_kept(spark):
    df = spark.createDataFrame([(1, 0.3), (0, 1.0)], "y int, p double")
    bins = metrics.calibration_bins(df).orderBy("bin").collect()
    # 0.3 lies below the edge 3 * 0.1, so it belongs to the third bin.
    assert [b["count"] for b in bins] == [0, 0, 1, 0, 0, 0, 0, 0, 0, 1] and bins[0].observed_rate is None
    bands = metrics.probability_bands(df).orderBy("lower").collect()
    assert [b.rows for b in bands] == [0, 0, 0, 0, 0, 1, 0, 1] and bands[0].mean_probability is None


def test_curves(scores):
    pts = metrics.curve_points(scores).orderBy("threshold").collect()
    assert pts[0].tpr == 1.0 and pts[0].fpr == 1.0
    assert all(a.tpr >= b.tpr and a.fpr >= b.fpr for a, b in zip(pts, pts[1:]))
    n = sum(r["count"] for r in metrics.calibration_curve(scores, 10, "quantile").collect())
    assert n == scores.count()


def test_threshold_rules(spark):
    sweep = spark.createDataFrame([
        (0.2, 0.50, 0.9, 0.25, 0.3, 0.6, 0.5), (0.4, 0.50, 0.8, 0.35, 0.5, 0.6, 0.6),
        (0.6, 0.50, 0.8, 0.35, 0.5, 0.6, 0.7), (0.8, 0.30, 0.2, 0.90, 0.9, 0.5, 0.8)],
        "threshold double, f1 double, recall double, precision double, specificity double, balanced_accuracy double, accuracy double")
    got = {r.rule: r.threshold for r in metrics.select_threshold(sweep, list(metrics.SELECTION_RULES)).collect()}
    assert got == {"best_f1": 0.2, "best_recall": 0.2, "best_precision": 0.8, "best_accuracy": 0.8, "f1_balanced": 0.2,
                   "f1_conservative": 0.2, "high_recall_precision_30": 0.4, "precision_priority_recall_60": 0.4,
                   "specificity_priority_recall_50": 0.4}
    assert metrics.select_threshold(sweep.filter("precision < 0.3"), ["high_recall_precision_30"]).count() == 0


def test_costs(scores):
    sweep = metrics.threshold_sweep(scores, metrics.percent_grid(5, 95, 5))
    best = {r.scenario: r for r in metrics.cheapest_threshold(metrics.add_costs(sweep)).collect()}
    rows = sweep.collect()
    for s, (a, b) in metrics.COST_SCENARIOS.items():
        cost, t = min((r.fp * a + r.fn * b, r.threshold) for r in rows)
        assert (best[s].total_cost, best[s].threshold) == (cost, t)
    assert best["balanced_1_to_1"].threshold_varies == (len({r.threshold for r in best.values()}) > 1)


def test_model_comparison(scores):
    r = {x.method: x for x in metrics.model_comparison(scores, {"m1": 0.6, "m2": 0.3}).collect()}
    assert r["m1"].f1 == pytest.approx(metrics.threshold_metrics(scores.filter("method = 'm1'"), 0.6).first().f1)
    assert r["m2"].threshold == 0.3 and 0 <= r["m2"].roc_auc <= 1


def test_rules(spark):
    m = spark.createDataFrame([("brier", 0.25), ("precision", 0.35), ("gone", None)], "metric string, value double")
    rs = [("brier", "ge", 0.2, "bad brier"), ("precision", "lt", 0.4, "low precision"), ("precision", "between", (0.5, 0.6), "no"),
          ("gone", "missing", None, "not measured")]
    assert {r.message for r in rules.flags(m, rs).collect()} == {"bad brier", "low precision", "not measured"}
    assert rules.diagnosis(m, rs, "fine").first().diagnosis == "bad brier"
    assert rules.diagnosis(m, [("brier", "gt", 9, "x")], "fine").first().diagnosis == "fine"
    limits = [("brier_ok", "brier", "lt", 0.2, True), ("precision_ok", "precision", "ge", 0.4, False), ("absent_ok", "absent", "lt", 1, True)]
    g = rules.gate(rules.metric_checks(m, limits)).first()
    assert (g.status, g.blocking_failures, g.conditions) == ("NO-GO", "absent_ok; brier_ok", "precision_ok")
    assert rules.gate(rules.metric_checks(m, limits[1:2])).first().status == "CONDITIONAL GO"
    assert rules.gate(rules.metric_checks(m, [("p", "precision", "le", 0.4, True)])).first().status == "GO"
    e = {r.metric: r.status for r in rules.evidence_table(m, [("c", "brier", 0.26, 0.02), ("c", "gone", 1, 1)]).collect()}
    assert e == {"brier": "PASS", "gone": "FAIL"}


def test_extract_and_availability(spark):
    report = spark.createDataFrame([("Brier", "0.2"), ("ece", "0.05"), ("auc", "text")], "key string, value string")
    table = spark.createDataFrame([("brier_score", "0.1")], "key string, value string")
    got = {r.metric: r.value for r in rules.extract_metrics(report, table, {
        "brier_score": ["brier_score", "brier"], "expected_calibration_error": ["ece"], "roc_auc": ["auc"]}).collect()}
    assert got == {"brier_score": 0.1, "expected_calibration_error": 0.05, "roc_auc": None}
    have = spark.createDataFrame([("a", True, 3), ("b", True, 0), ("c", False, 0)], "name string, available boolean, rows long")
    assert {r.name: r.passed for r in rules.availability_checks(["a", "b", "c", "d"], have).collect()} == {
        "a": True, "b": False, "c": False, "d": False}


def test_validate_scores(spark):
    good = spark.createDataFrame([(0.2, 0, 0.25), (0.25, 1, 0.25)], "p double, flag int, threshold double")
    assert all(r.passed for r in rules.validate_scores(good, 2, 0.25).collect())
    bad = spark.createDataFrame([(float("nan"), 0, 0.25), (1.5, 0, 0.3), (None, 0, 0.25)], "p double, flag int, threshold double")
    assert not any(r.passed for r in rules.validate_scores(bad, 2, 0.25).collect())
