import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from plumbline.llm import packing, token_counts

TEXTS = [None, "", " ", "  two  spaces ", "a\n b\n\n c", "x  y  z", "<|endoftext|> in text", "don't stop's",
         "tab\tand\x0bmore \x1c odd", "é ́x ΑΣ Σ", "1234 5678,90", "word " * 3000, "y" * 20000,
         "Ends here. And there! Or? " * 900, "<|startoftext|>a <|endoftext|>b"]


def rows(spark, texts=TEXTS):
    data = [(i, t, "other", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, `odd.name` string, n_tokens int")


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    out = token_counts.count_tokens(rows(spark), path, limit=10, batch_bytes=100)
    assert out.columns == ["doc_id", "text", "odd.name", "n_tokens", "n_bytes", "over_limit"]
    for r in out.collect():
        n = len(plain.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 10), r.text
    assert token_counts.count_tokens(rows(spark, []), path).count() == 0


def whole(spark, df, size, path=public_tokenizers.path("word_bpe_49k.json")):
    got = packing.pack(df, path, size=size).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        at = 0
        for r in seq:
            assert r.offset == at
            at += r.length
        assert at <= size
    return by_doc, by_seq


def test_packing_is_an_exact_round_trip(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for size in (64, 4096):
        by_doc, by_seq = whole(spark, rows(spark), size)
        for i, t in enumerate(TEXTS):
            ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            pieces = sorted(by_doc[i], key=lambda r: r.start)
            assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]]
            assert b"".join(p.ids for p in pieces) == ids.tobytes(), t
            assert zlib.crc32(b"".join(p.ids for p in pieces)) == zlib.crc32(ids.tobytes())
            assert {p.doc_tokens for p in pieces} == {len(ids)}
    assert packing.pack(rows(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_word_encoder_equals_the_library(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, rng = Tokenizer.from_file(path), np.random.default_rng(5)
    alphabet = list("aBcdEé.,!?;:$&()\"'’ \n\tİß\u0301\u0338Σσς1٣ªⅣ漢\u0958ᄀ\u1161한\u00a0\u3000😀_-") + ["'s", "'LL ", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(1500)]
    texts += ["don't. word." + "x" * 500 + ".", "x" * 500 + ". word, Word. wOrd!!", "", " ", "É. é. ÉÉ?"] * 3
    encoder = packing.WordEncoder(path)
    for entries in (packing.CACHE_ENTRIES, 50):
        monkeypatch.setattr(packing, "CACHE_ENTRIES", entries)
        for at in range(0, len(texts), 97):
            some = texts[at:at + 97]
            for text, ids in zip(some, encoder.encode(some), strict=True):
                assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text
            assert max(map(len, encoder.places)) <= packing.LONGEST_KEPT
    assert encoder.encode([]) == []


def test_packing_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 500)
    packer = packing._Packer(64, np.zeros(10, bool), 2, 5)
    out = []
    for k, n in enumerate([1300, 3, 0, 499, 700]):
        out += packer.add(k, np.arange(n, dtype="<u4"))
    out += packer.flush()
    for k, n in enumerate([1300, 3, 0, 499, 700]):
        mine = sorted(r for r in out if r[0] == k)
        assert b"".join(r[3] for r in mine) == np.append(np.arange(n), 2).astype("<u4").tobytes()


def test_cuts_are_optimal():
    rng = np.random.default_rng(1)
    for size in (8, 16, 32):
        for _ in range(30):
            marks = np.concatenate([[0], np.sort(rng.choice(np.arange(1, 90), 20, replace=False))])
            costs = rng.choice([0.0, 3.0, 7.0], len(marks))
            full, price = packing._candidates(marks, costs, size)

            def cost(a, b, c):
                n = b - a
                return (0 if n & (n - 1) == 0 else size - n) + packing.WINDOW_COST + c
            best = {0: 0.0}
            for j in range(1, len(full)):
                best[full[j]] = min(best[i] + cost(i, full[j], price[j]) for i in full[:j] if full[j] - i <= size)
            cuts = packing.choose_cuts(marks, costs, size)
            at = dict(zip(full.tolist(), price.tolist()))
            total = sum(cost(a, b, at[b]) for a, b in zip(cuts, cuts[1:]))
            assert np.isclose(total, best[full[-1]])


def test_padding_is_small(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    _, by_seq = whole(spark, df, 4096)
    lengths = [sum(r.length for r in s) for s in by_seq.values()]
    pad = sum(0 if n & (n - 1) == 0 else 4096 - n for n in lengths)
    print(len(lengths), pad / sum(lengths))
    assert pad < 0.01 * sum(lengths)
