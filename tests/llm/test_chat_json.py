import json

from plumbline.llm import chat

TALK = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]


def turns(df, layouts=chat.LAYOUTS):
    return sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.canonical_turns_json(df, "payload", layouts).collect())


def frame(spark, records):
    return spark.createDataFrame([(i, r if isinstance(r, str | None) else json.dumps(r)) for i, r in enumerate(records)], "row int, payload string")


def test_records_with_other_fields_keep_their_turns(spark):
    df = frame(spark, [
        {"id": 1, "messages": TALK, "source": "web"}, {"ID": 2, "Messages": TALK, "V2": {"a1": [1]}},
        {"id": 3, "instruction": "q", "output": "a"}, {"id": 4, "conversations": [{"from": "human", "value": "q", "Rank_1": 2}, {"from": "gpt", "value": "a"}]},
        {"conv_id": 5, "turn": 0, "role": "user", "text": "q"}, {"conv_id": 5, "turn": 1, "role": "assistant", "text": "a"},
        {"id": 6, "messages": []}, {"id": 7, "messages": None}])
    assert turns(df) == [(i, t, r, x) for i in range(1, 6) for t, r, x in ((0, "user", "q"), (1, "assistant", "a"))]
    assert chat.unmatched_json(df, "payload").count() == 0


def test_paths_are_nested(spark):
    """Equal bags of names under other parents are other layouts."""
    swapped = {"id": 1, "messages": [{"content": "c"}], "role": "r"}
    inside = {"box": {"id": 1, "prompt": "p", "completion": "c"}}
    df = frame(spark, [swapped, inside, {"id": 2, "prompt": {"deep": 1}, "completion": "c"}, {"id": 3, "prompt": "p", "completion": "c"}])
    assert turns(df) == [(3, 0, "user", "p"), (3, 1, "assistant", "c")]
    own = chat.Layout("boxed", ("box.id", "box.prompt"), "box", per_row=("t", "r", "x"))
    assert chat._with_layout(df, "payload", (own,)).filter("__layout = 0").count() == 1


def test_text_ids_stay_apart(spark):
    df = frame(spark, [{"id": "a-1", "messages": TALK}, {"id": "b-2", "messages": TALK}, {"id": 3, "prompt": "p", "completion": "c"}])
    out = chat.canonical_turns_json(df, "payload")
    assert {r.conv_id for r in out.collect()} == {"a-1", "b-2", "3"}
    assert chat.format_conversations(out).count() == 3


def test_unmatched_records_are_returned(spark):
    df = frame(spark, [{"id": 1, "messages": TALK}, {"other": 1}, "no json", None, "[1]", {"messages": TALK}])
    got = sorted((r.row, r.problem) for r in chat.unmatched_json(df, "payload").collect())
    assert got == [(1, "no layout"), (2, "no object"), (3, "no object"), (4, "no object"), (5, "no layout")]


def test_table_without_the_optional_field(spark):
    df = spark.createDataFrame([(1, "q", "a")], "id long, instruction string, output string")
    assert sorted(tuple(r) for r in chat.canonical_turns(df).collect()) == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
