import hashlib
import json

import pytest

from plumbline.llm import chat, exact_dedup
from pyspark.sql import functions as F


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(spark, keep):
    texts = ["a", "b", None, "", "a", "same" * 100, "same" * 100 + "x", "é", "é"] + ["hot"] * 500
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, sha int, t int")
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r.doc_id: r for r in exact_dedup.group_equal_texts(df.repartition(5), keep=keep).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert sorted(got) == list(range(len(texts)))
        for i, t in enumerate(texts):
            same = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
            best = max(same) if keep == "largest" else min(same)
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (best, len(same), i == best)
            assert got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_empty_repeated_rows_and_normalize(spark):
    df = spark.createDataFrame([(1, "A"), (1, "A"), (2, "a")], "doc_id long, text string")
    assert exact_dedup.group_equal_texts(df.limit(0)).count() == 0
    plain = exact_dedup.group_equal_texts(df).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in plain) == [(1, 1, 2), (1, 1, 2), (2, 2, 1)]
    lower = exact_dedup.group_equal_texts(df, normalize=F.lower).collect()
    assert {(r.keep_id, r.group_size) for r in lower} == {(2, 3)}


HARD = ["plain", "", None, "<|end|>", "<|turn|>user<|says|>x<|end|>", "%3C %25 %", "<s>[INST] é 🙂 \\", "a\nb"]


def test_chat_round_trip(spark):
    rows = [(c, t, r, x, "clash") for c in range(3) for t, (r, x) in
            enumerate(zip(["system", "user", "assistant", None, "assistant", "<|end|>", "assistant", "user"], HARD))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(chat.canonical_turns(df))
    for r in chat.read_back(out).collect():
        want = [((a or ""), (x or "")) for _, _, a, x, _ in rows[:8]]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.loss_text == "".join(x for a, x in want if a == "assistant")
    for r in out.collect():
        assert r.formatted.count("<|end|>") == 8 and len(r.loss_spans) == 3
    assert chat.format_conversations(chat.canonical_turns(df.limit(0))).count() == 0


def test_layouts(spark):
    def turns(df):
        got = chat.canonical_turns(df).collect()
        return sorted((r.conv_id, r.turn, r.role, r.text) for r in got)
    want = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    messages = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")]), (2, None)],
                                     "id long, messages array<struct<role:string,content:string>>")
    assert turns(messages) == want
    assert turns(messages.withColumn("extra", F.lit(1))) == want
    named = spark.createDataFrame([([("human", "q"), ("gpt", "a")], 1)],
                                  "conversations array<struct<from:string,value:string>>, id long")
    assert turns(named) == want
    assert turns(spark.createDataFrame([(1, "q", "a")], "id long, prompt string, completion string")) == want
    asked = spark.createDataFrame([(1, "q", None, "a"), (2, "q", "in", None)],
                                  "id long, instruction string, input string, output string")
    assert turns(asked) == [*want, (2, 0, "user", "q\n\nin"), (2, 1, "assistant", "")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1,)], "z long"))


def test_layouts_by_row(spark):
    docs = [{"id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
            {"id": 2, "prompt": "p", "completion": "c"}, {"id": 3, "instruction": "i", "input": "", "output": "o"},
            {"other": 1}]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs] + [("no json",), (None,)], "payload string")
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.canonical_turns_json(df, "payload").collect())
    assert got == [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "p"), (2, 1, "assistant", "c"),
                   (3, 0, "user", "i"), (3, 1, "assistant", "o")]


def test_fingerprint_ignores_order_and_types():
    assert chat.fingerprint(["b", "a"]) == chat.fingerprint(["a", "b"]) != chat.fingerprint(["a"])
