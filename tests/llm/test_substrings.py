import hashlib
import re
from pathlib import Path

import numpy as np
import pytest

from plumbline.llm import substrings


def brute(texts, window):
    docs = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts.items()}
    first, out = {}, {}
    for i in sorted(docs):
        for s in range(len(docs[i]) - window + 1):
            first.setdefault(tuple(docs[i][s:s + window]), (i, s))
    for i, w in docs.items():
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] != (i, s):
                gone[s:s + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def fixture(seed, vocab=40, window=20):
    rng = np.random.default_rng(seed)
    words = [f"é{i}" for i in range(vocab)]
    def text(n):
        return [words[j] for j in rng.integers(vocab, size=n)]
    passages = [text(n) for n in (window, window + 1, window - 1, window + 30)]
    texts = {}
    for i in range(60):
        t = text(int(rng.integers(0, 80)))
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(len(t) + 1))
            t = t[:at] + passages[int(rng.integers(4))] + t[at:]
        if rng.random() < 0.2 and texts:
            t = (texts[int(rng.choice(list(texts)))] or "").split() + t[:5]
        texts[i * 3] = "\n".join(t)
    base = text(100)
    for i in range(40):
        t = list(base)
        t[int(rng.integers(100))] = "changed"
        texts[1000 + i] = " ".join(t)
    for i in range(50):
        texts[2000 + i] = " ".join(passages[3])
    texts |= {3000: None, 3001: "", 3002: " \t ", 3003: "same " * 100, 3004: "same " * 60 + "x", 3005: "a b " * 50,
              3006: "one", 3007: "Q" * 5000}
    return texts


@pytest.mark.parametrize("seed, window, hot", [(0, 20, 5000), (1, 20, 3), (2, 8, 5000), (3, 5, 2)])
def test_equals_brute_force(spark, monkeypatch, seed, window, hot):
    monkeypatch.setattr(substrings, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 300)
    texts = fixture(seed, window=window)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "doc_id long, text string, n int, id int")
    got = substrings.remove_repeats(df.repartition(3), window=window).collect()
    want = brute(texts, window)
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], (r.doc_id, texts[r.doc_id])
        assert sum(s.end - s.start for s in r.removed_spans) == r.n_removed


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "w " * 30), (1, "w " * 30)], "doc_id long, text string")
    assert substrings.remove_repeats(df.limit(0)).count() == 0
    assert [r.n_removed for r in substrings.remove_repeats(df).collect()] == [29, 29]


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(5)
    segments = [rng.integers(0, 3, int(n)).astype(np.uint64) for n in rng.integers(8, 30, 40)]
    index = substrings.ShardIndex(segments, 8)
    at = np.concatenate([index.first[i] + np.arange(len(s) - 7) for i, s in enumerate(segments)])
    low, high = index.occurrences(at)
    grams = [tuple(index.text[a:a + 8]) for a in at]
    for a, lo, hi, g in zip(at, low, high, grams):
        same = {int(b) for b, h in zip(at, grams) if h == g}
        if len(same) > 1:
            assert set(index.order[lo:hi].tolist()) == same
        else:
            assert hi - lo <= 1 or set(index.order[lo:hi].tolist()) == same


def test_tables_go_when_they_are_not_needed(spark, monkeypatch):
    """When the shards are searched, neither the anchors nor the segments of all documents are on disk."""
    found = []

    def search(window, real=substrings._search):
        found.extend(c for at in tables for c in (spark.read.parquet(at).columns if Path(at).exists() else []))
        return real(window)

    def hold(df, real=substrings.hold):
        table = real(df)
        tables.append(table.inputFiles()[0].removeprefix("file://").rpartition("/")[0])
        return table

    tables = []
    monkeypatch.setattr(substrings, "hold", hold)
    monkeypatch.setattr(substrings, "_search", search)
    texts = fixture(4)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(df).collect()}
    assert got == brute(texts, 20)
    assert found and "kind" not in found and "anchor" not in found
