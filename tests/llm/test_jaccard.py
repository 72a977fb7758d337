import re
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import common, jaccard


def brute(texts, words, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = ({tuple(w[j:j + words]) for j in range(len(w) - words + 1)} or {tuple(w)}) if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def fixture(seed):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(60)]
    def text(n):
        return [vocab[j] for j in rng.integers(60, size=n)]
    texts, at = {}, 0
    passage = text(12)
    for g in range(12):
        base = text(int(rng.integers(3, 120)))
        for _ in range(int(rng.integers(1, 14))):
            t = list(base)
            for _ in range(int(rng.integers(0, 4))):
                t[int(rng.integers(len(t)))] = vocab[int(rng.integers(60))]
            texts[at] = " ".join(t) + (" Z" if rng.random() < 0.2 else "")
            at += 1
    for _ in range(40):
        t = text(int(rng.integers(1, 9))) + passage + text(int(rng.integers(1, 9)))
        texts[at] = "\t".join(t)
        at += 1
    for extra in (None, "", " \n", "one", "ONE", "one two", "One Two", "É é", "é é", "x " * 5000, "x " * 400):
        texts[at] = extra
        at += 1
    for _ in range(300):
        texts[at] = "the same text again and again in one large group of copies"
        at += 1
    return texts


@pytest.mark.parametrize("seed, words, percent", [(0, 4, 85), (1, 5, 80), (2, 2, 60)])
def test_components_equal_brute_force(spark, seed, words, percent):
    texts = fixture(seed)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "doc_id long, text string, n int, id int")
    got = jaccard.near_duplicates(df.repartition(3), words=words, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts, words, percent)
    assert len(got) == len(texts)


def test_chain_empty_and_repeated(spark):
    base = [f"v{i}" for i in range(200)]
    chain = [" ".join(base[k:k + 100]) for k in range(0, 60, 3)]
    df = spark.createDataFrame([(100 - i, t) for i, t in enumerate(chain)], "doc_id long, text string")
    got = jaccard.near_duplicates(df, words=4, percent=85).collect()
    assert {r.component_id for r in got} == {81} and len(got) == 20
    assert jaccard.near_duplicates(df.limit(0)).count() == 0
    twice = jaccard.near_duplicates(df.union(df)).collect()
    assert len(twice) == 40


def test_small_sketch_gives_the_same(spark, monkeypatch):
    texts = fixture(3)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = sorted(map(tuple, jaccard.near_duplicates(df, words=4, percent=85).collect()))
    monkeypatch.setattr(jaccard, "ORDERS", (1, 2, 3))
    assert sorted(map(tuple, jaccard.near_duplicates(df, words=4, percent=85).collect())) == want


def test_sets_of_many_texts_at_once(monkeypatch):
    """Texts that are worked on together have the sets of each by itself, by words that bytes.split() finds."""
    import numpy as np
    import pyarrow as pa

    from plumbline.llm import jaccard
    from plumbline.llm.common import mix64, ngram_ids
    texts = ["a b c d e f", None, "", "A", "b  c", "a a a a a a a", " \t\n", "x" * 500 + " y z", "a b c", "F e d c b a b c d e F",
             "\u00c9 \u00e9\x1cab\x0bc \x85d\u3000e f", "ab", "ba", "end", "end end"]
    alone = {w: int(jaccard.word_ids(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0])
             for t in texts for w in (t or "").encode().lower().split()}
    assert len(set(alone.values())) == len(alone)
    for together, piece in ((1 << 20, 1 << 18), (1 << 20, 7), (1, 1)):
        monkeypatch.setattr(jaccard, "TOGETHER", together)
        monkeypatch.setattr(jaccard, "PIECE", piece)
        jaccard._powers.cache_clear()
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "t"]).slice(1)
        found = {}
        for keys, *some in jaccard._texts(iter([batch, batch.slice(0, 0)])):
            s, bounds = jaccard.Shingler(4).sets(*some)
            found |= {k: s[a:b].tolist() for k, a, b in zip(keys.to_pylist(), bounds, bounds[1:])}
        assert list(found) == list(range(1, len(texts)))
        for k, own in found.items():
            ids = np.array([alone[w] for w in (texts[k] or "").encode().lower().split()], np.uint64)
            n = min(4, len(ids))
            assert own == (np.unique(mix64(ngram_ids(ids, n), n)).tolist() if n else [])
    jaccard._powers.cache_clear()


def test_one_task_merges_a_whole_filter_in_little_memory():
    rng = np.random.default_rng(4)
    parts = [np.unique(rng.integers(0, common.BitFilter.CHUNK, 300)).astype(np.uint32) for _ in range(256)]
    chunks = common.BitFilter.BITS // common.BitFilter.CHUNK
    rows = pa.RecordBatch.from_arrays([pa.array([i % chunks for i in range(256)]), pa.array([p.tobytes() for p in parts])], ["chunk", "body"])
    tracemalloc.start()
    got = {b.column(0)[0].as_py(): b.column(1)[0].as_py() for b in common._merge_bits(iter([rows]))}
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
    assert len(got) == chunks
    for chunk, body in got.items():
        bits = np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little")
        assert np.array_equal(np.flatnonzero(bits), np.union1d(parts[chunk], parts[chunk + chunks]))


def test_memory_is_returned_when_the_last_batch_is_gone(monkeypatch):
    class Batch:
        pass

    seen, alive = [], []

    @common.giving_back
    def run(batches):
        for batch in batches:
            seen.append(weakref.ref(batch))
            yield 1

    monkeypatch.setattr(common, "give_back", lambda: alive.append([ref() is not None for ref in seen]))
    assert list(run(Batch() for _ in range(3))) == [1, 1, 1] and alive == [[False] * 3]


def unlike_hub(n=70, seed=6):
    """Copies of one text with two changed places each, of which most pairs link; the text with the smallest key is too far from all."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(200)]
    texts = {0: " ".join(base[:100] + [f"z{i}" for i in range(100)])}
    for k in range(1, n):
        t = list(base)
        for at in rng.integers(0, 200, 2):
            t[at] = f"x{k}_{at}"
        texts[k] = " ".join(t)
    return texts


def test_a_hub_unlike_its_group_leaves_few_pairs(spark, monkeypatch):
    """The pairs to verify follow the number of texts, not the square of a group."""
    seen = []

    def verified(self, pairs, real=jaccard._Search.verified):
        seen.append(pairs.count())
        return real(self, pairs)

    monkeypatch.setattr(jaccard._Search, "verified", verified)
    texts = unlike_hub()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = jaccard.near_duplicates(df, words=5, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts, 5, 80)
    assert sum(seen) < 12 * len(texts)  # before: 69 * 68 / 2 pairs


def test_a_pair_is_met_at_few_of_its_tokens(spark):
    """Two sets with many shared tokens come from a few of them, and no pair of different components is lost."""
    rng = np.random.default_rng(7)
    sets = {i: set(rng.choice(90, 80, replace=False).tolist()) for i in range(12)} | {20: {1, 2}, 21: {200, 201}, 22: {200}}
    comp = {i: (0 if i < 4 else i) for i in sets}
    hub = {t: min(i for i, s in sets.items() if t in s) for s in sets.values() for t in s}
    rows = spark.createDataFrame([(t, i, comp[i], hub[t]) for i, s in sets.items() for t in s], "token long, id long, comp long, hub long")
    small = spark.createDataFrame([(i, 80) for i in sets], "id long, n long")
    got = [tuple(r) for r in jaccard._between(rows, small, jaccard.F.lit(True)).collect()]
    shared = {(a, b): [t for t in sets[a] & sets[b] if hub[t] not in (a, b)] for a in sets for b in sets if a < b and comp[a] != comp[b]}
    first = {p for p, s in shared.items() if s and min(sets[p[0]] & sets[p[1]]) in s}
    assert first <= set(got) <= {p for p, s in shared.items() if s}
    assert len(got) < 0.2 * sum(map(len, shared.values()))  # before: once for every token
