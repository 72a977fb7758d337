import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing, quality, topk, toxicity


def corpus(spark, n=400):
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta", "omega", "stone", "river", "tree"]
    docs, labels = [], []
    for i in range(n):
        body = [words[j] for j in rng.integers(len(words), size=int(rng.integers(1, 90)))]
        toxic, bad = i % 4 == 0, i % 3 == 0
        if toxic:
            body[int(rng.integers(len(body)))] = "vile" + "abcdefgh"[i % 8]
        text = " ".join(w.upper() + "!!" for w in body) if bad else " ".join(body)
        docs.append((i, text, 9.0, "x"))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(n, None, 1.0, None), (n + 1, "", 1.0, None), (n + 2, " \n ", 1.0, None), (n + 3, "q" * 3000, 1.0, None)]
    labels += [(7, 0, 0), (None, 1, 1), (n, 1, 0), (3, None, None)]
    return (spark.createDataFrame(docs, "doc_id long, text string, score double, k string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("module, label, threshold", [(quality, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_classifiers_on_held_out_rows(spark, module, label, threshold):
    docs, labels = corpus(spark)
    model = module.fit(docs, labels, label)
    got = {r.doc_id: r for r in module.score(docs, model, threshold=threshold).collect()}
    assert sorted(got) == list(range(404))
    truth = {i: int(i % 3 != 0) if label == "quality" else int(i % 4 == 0) for i in range(400)}
    for i, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [i for i in truth if got[i].held_out and i != 7]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.9
    assert module.score(docs.limit(0), model).count() == 0
    again = {r.doc_id: r.score for r in module.score(docs.repartition(7), model).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-5 for i in got)


def test_no_labels(spark):
    docs, labels = corpus(spark, 20)
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert max(r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0), "toxic")).collect()) < 1e-6


def test_network_gradients(monkeypatch):
    net = toxicity.Network()
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    words = [b"\x02ab\x03", b"\x02cde\x03", b"\x02fghijk\x03"]
    ids, y = np.array([[0, 1, 2, 1], [2, 0, 3, 3]]), np.array([1.0, 0.0])
    mask = ids != 3

    def loss():
        x, _ = net.inputs(words)
        x = np.concatenate([x, np.zeros((1, x.shape[1]))])
        z = net.logits((x @ net.p["Wf"] + net.p["cf"], x @ net.p["Wr"] + net.p["cr"]), ids, mask)
        return np.mean(np.log1p(np.exp(z)) - y * z)
    g = net.gradients(words, ids, mask, y)
    for k, v in net.p.items():
        flat, grad = v.reshape(-1), np.asarray(g[k]).reshape(-1)
        for i in np.argsort(-np.abs(grad))[:3]:
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-3 - grad[i]) < 1e-3 * max(1e-2, abs(grad[i])) + 2e-5, (k, i)


def test_every_window_counts():
    net = toxicity.train(["calm words here"] * 30 + ["calm awful here"] * 30, [0] * 30 + [1] * 30)
    for at in (0, 31, 32, 40, 199):
        text = ["calm"] * 200
        text[at] = "awful"
        tops = [w.max() for w in toxicity.window_logits(net, [" ".join(text), "calm " * 200])]
        assert tops[0] > 0 > tops[1]
    long = toxicity.window_logits(net, ["z" * 100_000 + " awful", None, ""])
    assert long[0].max() > 0 and len(long[1]) == len(long[2]) == 0


def brute(codes, asks, k):
    out = set()
    for q in asks:
        order = sorted((bin((codes[q] ^ c) & (2**64 - 1)).count("1"), i) for i, c in codes.items() if i != q)[:k]
        out |= {(q, i, n + 1, d) for n, (d, i) in enumerate(order)}
    return out


@pytest.mark.parametrize("blocks", [(65_536, 4096), (40, 3)])
def test_top_k_is_exact(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "INDEX_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[1])
    rng = np.random.default_rng(4)
    codes = {i: int(c) for i, c in enumerate(rng.integers(-2**63, 2**63, 150))}
    codes |= {i: codes[3] for i in range(150, 210)}
    codes |= {i: codes[5] ^ (1 << (i % 64)) if i % 64 != 63 else codes[5] for i in range(210, 260)}
    df = spark.createDataFrame([(i, c, 1) for i, c in codes.items()] + [(999, None, 1), (None, 5, 1)],
                               "id long, code long, distance int")
    got = topk.nearest(df, "code", "id", F.col("id") % 10 == 0, 7)
    assert {tuple(r) for r in got.collect()} == brute(codes, [i for i in codes if i % 10 == 0], 7)
    assert topk.nearest(df.limit(0), "code", "id", F.col("id") == 1, 7).count() == 0
    few = df.filter("id in (0, 1)")
    assert {tuple(r)[:3] for r in topk.nearest(few, "code", "id", F.lit(True), 7).collect()} == {(0, 1, 1), (1, 0, 1)}


def test_sign_code(spark):
    df = spark.createDataFrame([([1.0, -1.0, None, float("nan"), 2.0],), ([1.0] * 70,), (None,), ([],)], "v array<float>")
    assert [r[0] for r in df.select(topk.sign_code(F.col("v"))).collect()] == [17, -1, None, 0]


def test_raking_meets_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "abc"[int(rng.integers(3)) if i % 3 else 0], "xy"[int(rng.integers(2))], int(rng.integers(1, 50)), "w")
            for i in range(3000)] + [(3000, None, None, 5, "w"), (3001, "a", "x", None, "w")]
    df = spark.createDataFrame(rows, "doc_id long, s string, l string, n long, weight string")
    goal = {"s": spark.createDataFrame([("a", 0.2), ("b", 0.5), ("c", 0.2999), (None, 0.0001)], "s string, target double"),
            "l": spark.createDataFrame([("x", 0.3), ("y", 0.6999), (None, 0.0001)], "l string, target double")}
    out = mixing.sample_to_targets(df, ["s", "l"], "doc_id", "n", goal, rounds=20).toPandas()
    assert len(out) == len(rows) and out.probability.max() == 1
    out["mass"] = out.probability * out.n.fillna(0)
    share = out.groupby("s", dropna=False).mass.sum() / out.mass.sum()
    for v, t in (("a", 0.2), ("b", 0.5), ("c", 0.2999)):
        assert abs(share[v] - t) < 1e-3
    kept = out[out.kept]
    assert abs(kept[kept.s == "b"].n.sum() / kept.n.sum() - 0.5) < 0.05
    assert mixing.sample_to_targets(df.limit(0), ["s", "l"], "doc_id", "n").count() == 0
    tempered = mixing.sample_to_targets(df, ["s", "l"], "doc_id", "n", power=1.0, rounds=4).toPandas()
    assert tempered.kept.mean() > 0.98
