"""A large table is not read again for every few models: scores go in batches that grow with its rows."""

import numpy as np

from plumbline.operators import batched


def test_batches_hold_scores_per_row(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i), i % 3 // 2, 0, i % 2, i % 2) for i in range(40)], "id long, a double, y int, repeat int, fold int, split int")
    e = batched.encode(df, ["a"], [], ["id"])
    jobs = [batched.LogisticJob(f"m{k}", s, ["a"], [], 1.0, False) for s in e.splits.values() for k in range(20)]
    for k, j in enumerate(jobs):
        j.base = np.array([0.0, 1.0, 0.0]) * (k % 2)
    seen, plain = [], batched._ranked_together
    monkeypatch.setattr(batched, "_ranked_together", lambda rows, scores, sizes: seen.append(len(sizes)) or plain(rows, scores, sizes))
    monkeypatch.setattr(batched, "SCORES_AT_ONCE", 1)
    found = {(r["model"], r["split"]): r["roc_auc"] for r in batched.rank_logistic(e, jobs).collect()}
    assert len(found) == 40 and found["m0", 0] == 0.5 and found["m1", 0] != 0.5
    assert seen == [32, 8]  # 20 scores each, 16 a row
