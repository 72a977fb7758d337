"""Models of all folds fitted together, against plain versions of one fold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import ordered
from plumbline.operators import batched, metrics, models, splits


@pytest.fixture(scope="module")
def folded(spark):
    """120 rows with gaps in a number and a category, on 3 folds x 2 repeats."""
    r = random.Random(5)
    rows = []
    for i in range(120):
        a, b, c = r.gauss(50, 9), r.choice([None, 1.0, 2.0, 2.0, 7.5]), r.choice(["u", "v", "v", None])
        rows.append((i, a, b, c, int(r.random() < 1 / (1 + np.exp(-(a - 50) / 6 - (b or 0) / 4 + (c == "v"))))))
    df = spark.createDataFrame(rows, "id long, a double, b double, c string, y int")
    return splits.repeated_stratified_kfold(df, "y", ["id"], 3, (1, 2)).cache()


def plain_matrix(rows, train):
    """Imputed, scaled numbers and one-hot levels, learned from the training rows."""
    columns = [np.ones(len(rows))]
    for c in ("a", "b"):
        x = np.array([np.nan if r[c] is None else r[c] for r in rows])
        x = np.where(np.isnan(x), np.nanmedian(x[train]), x)
        columns.append((x - x[train].mean()) / x[train].std())
    known = [r["c"] for r, t in zip(rows, train) if t and r["c"] is not None]
    mode = max(sorted(set(known)), key=known.count)
    columns += [np.array([float((r["c"] or mode) == v) for r in rows]) for v in sorted(set(known))]
    return np.array(columns).T


@pytest.mark.parametrize("C,balanced", [(0.05, True), (2.0, False)])
def test_newton_solves_the_score_equations(spark, folded, C, balanced):
    rows = sorted(folded.filter("repeat = 1").collect(), key=lambda r: r["id"])
    e = batched.encode(folded, ["a", "b"], ["c"], ["id"])
    jobs = [batched.LogisticJob(f"m{k}", s, ["a", "b"], ["c"], C, balanced) for s in e.splits.values() for k in (0, 1)]
    batched.fit_logistic(e, jobs)
    found = {(r["id"], r["model"], r["repeat"]): r for r in batched.predict_logistic(e, jobs).collect()}
    assert len(found) == 120 * 2 * 2
    y = np.array([r["y"] for r in rows])
    for job in jobs:
        if job.split.repeat != 1:
            continue
        train = np.array([r["fold"] != job.split.fold for r in rows])
        x = plain_matrix(rows, train)
        p = 1 / (1 + np.exp(-x @ job.beta))
        w = np.where(y == 1, train.sum() / (2 * y[train].sum()), train.sum() / (2 * (1 - y[train]).sum())) if balanced else np.ones(len(y))
        gradient = x[train].T @ (w * (p - y))[train] + np.r_[0, job.beta[1:]] / C
        assert np.abs(gradient).max() < 1e-5
        for r, q, t in zip(rows, p, train):
            if not t:
                assert found[r["id"], job.name, 1]["p"] == pytest.approx(q, abs=1e-9)
    shown = batched.predict_logistic(e, jobs[:1], held=False)
    assert shown.count() == sum(r["fold"] != jobs[0].split.fold for r in folded.filter("repeat = 0").collect())


def plain_boosting(q, y, train, rate, depth, leaf, rounds):
    """Margins after every round of trees on bins, features 0 and 1 ordered, 2 by level."""
    f = np.full(len(y), np.log(y[train].mean() / (1 - y[train].mean())))
    out = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h, node = y - p, p * (1 - p), np.zeros(len(y), int)
        for level in range(depth):
            fresh = node * 2
            for n in range(2 ** level):
                inside = node == n
                here, best = inside & train, (1e-12, None)
                if not here.any():
                    continue
                for k in range(3):
                    for b in range(q[:, k].max() + 1):
                        right = q[:, k] > b if k < 2 else q[:, k] != b
                        lo, hi = here & ~right, here & right
                        if min(lo.sum(), hi.sum()) < leaf:
                            continue
                        gain = g[lo].sum() ** 2 / lo.sum() + g[hi].sum() ** 2 / hi.sum() - g[here].sum() ** 2 / here.sum()
                        if gain > best[0] + 1e-12:
                            best = (gain, right)
                if best[1] is not None:
                    fresh += inside & best[1]
            node = fresh
        for n in range(2 ** depth):
            here = (node == n) & train
            if here.any():
                f = f + rate * np.where(node == n, g[here].sum() / h[here].sum(), 0.0)
        out.append(f.copy())
    return out


@pytest.mark.parametrize("driver", [1 << 22, 0])
def test_boosting_and_stages(spark, folded, monkeypatch, driver):
    """Sums on the driver or by a shuffle give the trees of a plain version; stages are prefixes of one fit."""
    monkeypatch.setattr(batched, "DRIVER_CELLS", driver)
    e = batched.encode(folded, ["a", "b"], ["c"], ["id"])
    jobs = [batched.BoostJob({2: "two", 3: "three"}, s, ["a", "b"], ["c"], 0.3, 2, 4, 1.0) for s in e.splits.values()]
    found = {(r["id"], r["model"], r["repeat"]): r["p"] for r in batched.fit_boosted(e, jobs).collect()}
    assert len(found) == 120 * 2 * 2
    edges = batched._edges(e)
    rows = sorted(folded.filter("repeat = 0").collect(), key=lambda r: r["id"])
    y = np.array([r["y"] for r in rows])
    for (repeat, fold), split in e.splits.items():
        if repeat:
            continue
        q = np.array([[*[np.searchsorted(b, split.numbers[c][0] if r[c] is None else r[c]) for c, b in zip("ab", edges)],
                       split.modes["c"] if r["c"] is None else e.levels["c"].index(r["c"])] for r in rows])
        train = np.array([r["fold"] != fold for r in rows])
        plain = plain_boosting(q, y, train, 0.3, 2, 4, 3)
        for name, margins in (("two", plain[1]), ("three", plain[2])):
            for r, m, t in zip(rows, margins, train):
                if not t:
                    assert found[r["id"], name, 0] == pytest.approx(1 / (1 + np.exp(-m)), abs=1e-9)


def test_sampled_rows_do_not_depend_on_blocks(spark, folded, monkeypatch):
    e = batched.encode(folded, ["a"], [], ["id"])
    jobs = [batched.BoostJob({2: "m"}, s, ["a"], [], 0.3, 1, 2, 0.7) for s in e.splits.values()]
    first = sorted(map(tuple, batched.fit_boosted(e, jobs).collect()))
    monkeypatch.setattr(batched, "ROWS", 7)
    monkeypatch.setattr(batched, "BLOCK", 1)
    second = sorted(map(tuple, batched.fit_boosted(e, jobs).collect()))
    assert [r[0] for r in first] == [r[0] for r in second] and np.allclose([r[2] for r in first], [r[2] for r in second])


def test_refit_training_scores_and_class_weights(spark, folded):
    spec = models.logistic("lr", ["a", "b"], ["c"])
    ranked, best, model = models.search_and_refit(folded, spec, {"C": [0.01, 1.0], "balanced": [False, True]}, ["id"])
    rows = ranked.collect()
    assert len({r["parameters"] for r in rows}) == 4 and all(r["train_roc_auc_mean"] > 0.5 for r in rows)
    assert best.name == next(r["model"] for r in rows if r["rank"] == 1)
    assert models.score(folded.filter("repeat = 0"), model).count() == 120


def test_production_table_is_validated(spark, folded, tmp_path):
    spec = models.logistic("lr", ["a", "b"], ["c"])
    one = folded.filter("repeat = 0").select("id", "a", "b", "c", "y")
    checks = {r["check"]: r["passed"] for r in models.training_checks(one, spec, ["id"]).collect()}
    assert all(checks.values()) and len(checks) == 8
    for bad, name in ((one.unionByName(one.limit(1)), "identifier_unique"), (one.withColumn("y", F.lit(1)), "each_class_fills_the_folds"),
                      (one.drop("a"), "features_present"), (one.withColumn("b", F.lit(None).cast("double")), "features_have_values")):
        with pytest.raises(ValueError, match=name):
            models.fit_production(bad, spec, str(tmp_path / "m"), ids=["id"])


def test_narrow_values_are_split_into_finer_buckets(spark, monkeypatch):
    """1e9 + i / 1e6 shares one octave and one first bucket; quantiles and totals stay exact."""
    df = spark.range(20000).select((1e9 + F.col("id") / 1e3).alias("v"), (F.col("id") % 2).alias("k"))
    plain = {r["k"]: r["q"] for r in ordered.quantiles(df, "v", [0.1, 0.5], ["k"]).collect()}
    totals = sorted(map(tuple, ordered.running_totals(df.limit(3000), "v", {"n": F.lit(1)}).collect()))
    monkeypatch.setattr(ordered, "MOST_ROWS", 50)
    assert {r["k"]: r["q"] for r in ordered.quantiles(df, "v", [0.1, 0.5], ["k"]).collect()} == plain
    assert sorted(map(tuple, ordered.running_totals(df.limit(3000), "v", {"n": F.lit(1)}).collect())) == totals
    sizes = ordered._bucketed(df.select("v"), "v", [], False).groupBy("__bucket").count().agg(F.max("count")).first()[0]
    assert sizes <= 50
    refined = ordered._bucketed(df.select("v"), "v", [], False).orderBy("v").select("__bucket").collect()
    assert all(a[0] <= b[0] for a, b in zip(refined, refined[1:]))
    one = spark.range(300).select(F.lit(4.0).alias("v"))
    assert ordered.quantiles(one, "v", [0.5]).first()["q"] == [4.0]


def test_fold_tables_have_one_row_per_row(spark, folded):
    one = folded.filter("repeat = 0").select("id", "y")
    table = splits.fold_table(one, "y", ["id"], 3, (1, 2)).collect()
    long = {(r["id"], r["repeat"]): r["fold"] for r in folded.collect()}
    assert len(table) == 120 and all(r["folds"] == [long[r["id"], 0], long[r["id"], 1]] for r in table)
    held = splits.holdout_table(one, "y", ["id"], 4, 0.25)
    assert held.count() == 120 and all(s in (29, 30, 31) for s in [
        sum(r["holdouts"][i] for r in held.collect()) for i in range(4)])


def test_compound_rules_and_feature_contract(spark):
    from plumbline.operators import rules
    wide = spark.createDataFrame([("a", 0.3, 0.9), ("b", 0.5, 0.9), ("c", 0.3, None)], "k string, precision double, recall double")
    found = rules.compound_flags(rules.metrics_long(wide, ["precision", "recall"], ["k"]), [
        ([("precision", "lt", 0.4), ("recall", "gt", 0.7)], "costly"), ([("recall", "missing", None)], "unknown"),
        ([("recall", "between", (0.8, 0.95))], "high"), ([("absent", "lt", 1.0)], "never")], ["k"]).collect()
    assert sorted((r["k"], r["priority"], r["metrics"], r["message"]) for r in found) == [
        ("a", 1, "precision|recall", "costly"), ("a", 3, "recall", "high"), ("b", 3, "recall", "high"), ("c", 2, "recall", "unknown")]
    df = spark.createDataFrame([(1, None)], "x int, y int")
    got = {r["check"]: (r["passed"], r["detail"]) for r in rules.feature_contract(["x", "y", "z"], df, ["z", "y", "x"], ["x", "y"]).collect()}
    assert got == {"contract_is_distinct": (True, ""), "metadata_features_match": (True, ""), "model_features_match": (False, "z"),
                   "table_has_features": (False, "z"), "features_have_values": (False, "y"), "table_has_rows": (True, "")}
    assert not {r["check"]: r["passed"] for r in rules.feature_contract(["x"], df.limit(0), ["x"], ["x"]).collect()}["table_has_rows"]


def test_sigmoid_is_applied_to_what_it_was_fitted_on(spark):
    from plumbline.operators import calibrate
    r = random.Random(6)
    rows = [(p, int(r.random() < p * p)) for p in (r.random() for _ in range(400))]
    df = spark.createDataFrame(rows, "p double, y int")
    for raw, smooth in ((True, False), (False, False), (True, True)):
        model = calibrate.fit_platt(df, raw=raw, smooth=smooth)
        got = np.array([x["q"] for x in calibrate.apply_platt(df, model, out="q").orderBy("p").collect()])
        x = np.array(sorted(p for p, _ in rows))
        z = x if raw else np.log(x / (1 - x))
        assert np.allclose(got, 1 / (1 + np.exp(-(model.intercept + model.slope * z))))
        y = np.array([b for _, b in sorted(rows)], float)
        if smooth:
            y = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        assert abs((got - y).sum()) < 1e-5 and abs(((got - y) * z).sum() + (0 if smooth else model.slope)) < 1e-5
    assert calibrate.fit_platt(df.limit(0)).slope == 0.0


def test_cells_rank_like_rows(spark, folded, monkeypatch):
    """Scores of cells with counts give the metrics of the predictions of the rows, whatever the blocks and hot cells."""
    specs = [models.gbt(f"g{n}-{rate}", ["b"], ["c"], iterations=n, rate=0.3, depth=2, min_leaf=2, subsample=rate) for n, rate in ((1, 1.0), (2, 0.7))]
    specs.append(models.gbt("again", ["b"], ["c"], iterations=1, rate=0.3, depth=2, min_leaf=2))
    rows = metrics.ranking_metrics(models.oof_pooled(folded, specs, ["id"]), ["model", "split"]).collect()
    plain = {(r["model"], r["split"]): (r["roc_auc"], r["pr_auc"]) for r in rows}
    assert len(plain) == 3 * 6
    seen = []
    monkeypatch.setattr(models, "oof_pooled", lambda *a, **k: seen.append(a))
    for blocks in (2,):
        monkeypatch.setattr(batched, "ROWS", blocks)
        found = {(r["model"], r["split"]): (r["roc_auc"], r["pr_auc"]) for r in models.split_ranking(folded, specs, ["id"]).collect()}
        assert found.keys() == plain.keys() and not seen
        assert all(np.allclose(found[k], plain[k]) for k in plain)
    e = batched.encode(folded, ["b"], ["c"], ["id"])
    grown = batched._blocks(e, batched._edges(e), list(e.splits.values())).collect()
    assert sum(len(b["q"]) for b in grown) < 120 and sum(b["all"].sum() for b in grown) == 120
    monkeypatch.undo()
    monkeypatch.setattr(batched, "MOST_CELLS", 3)
    assert {(r["model"], r["split"]) for r in models.split_ranking(folded, specs[:1], ["id"]).collect()} == {k for k in plain if k[0] == specs[0].name}
