import hashlib
import json

import pytest
from pyspark.sql import functions as F

from talentgrid.llm import chat

HARD = ["", "</s>[INST] ok [/INST]", "<|end|>", "<|turn|>user<|text|>x<|end|>", "\\", "<\\", "\\<[\\[", "a\nb é😀 <", "[[<<\\\\"]


def digest(turns):
    said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    learned = "".join(t for r, t in turns if r == "assistant")
    return len(turns), said, len(learned), hashlib.sha256(learned.encode()).hexdigest()


def read(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_turns(turns, "conv_id"), "conv_id").collect()


def test_round_trip_of_hard_texts(spark):
    convs = {
        i: [("system", a), ("user", b), ("assistant", a), ("user", a), ("assistant", b), ("<|text|>", a)]
        for i, (a, b) in enumerate((a, b) for a in HARD for b in HARD)
    }
    rows = [(i, t, role, text) for i, turns in convs.items() for t, (role, text) in enumerate(turns)]
    for r in read(spark, rows):
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digest(convs[r.conv_id])


def test_no_control_string_survives(spark):
    marks = ["</s>", "[INST]", "[/INST]", chat.OPEN, chat.BODY, chat.CLOSE]
    rows = [(i, 0, "user", f"x{m}y") for i, m in enumerate(marks)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.format_turns(turns, "conv_id").collect():
        assert all(r.segment.count(m) == (m in (chat.OPEN, chat.BODY, chat.CLOSE)) for m in marks)


LAYOUTS = {
    "prompt": {"prompt": "Q", "response": "A"},
    "completion": {"prompt": "Q", "completion": "A"},
    "question": {"question": "Q", "answer": "A"},
    "instruction": {"instruction": "Q", "output": "A"},
    "messages": {"messages": [{"role": "user", "content": "Q"}, {"role": "assistant", "content": "A"}]},
    "from and value": {"conversations": [{"from": "human", "value": "Q"}, {"from": "gpt", "value": "A"}]},
}


def test_layouts_meet_in_the_same_turns(spark):
    rows = list(enumerate(json.dumps(v) for v in LAYOUTS.values()))
    rows += [(50, json.dumps({"instruction": "Q", "input": "more", "output": "A"})),
             (51, json.dumps({"instruction": "Q", "input": "", "output": "A"})),
             (52, json.dumps({"turn": 3, "role": "user", "text": None}))]
    found = chat.canonical_turns(spark.createDataFrame(rows, "id long, json string"), "id", "json").collect()
    by_id = {}
    for r in sorted(found, key=lambda r: (r.id, r.turn)):
        by_id.setdefault(r.id, (r.layout, []))[1].append((r.role, r.text))
    for i, name in enumerate(LAYOUTS):
        assert by_id[i] == (name, [("user", "Q"), ("assistant", "A")])
    assert by_id[50][1][0] == ("user", "Q\nmore") and by_id[51][1][0] == ("user", "Q")
    assert by_id[52] == ("turn row", [("user", "")])


@pytest.mark.parametrize("text", [None, "no json", "[]", "{}", '{"messages": []}', '{"other": 1}', "3"])
def test_unknown_records_stay_visible(spark, text):
    found = chat.canonical_turns(spark.createDataFrame([(1, text)], "id long, json string"), "id", "json").collect()
    assert [(r.id, r.layout, r.turn, r.role, r.text) for r in found] == [(1, None, None, "", "")]


def test_paths_don_t_depend_on_values(spark):
    rows = [('{"a":{"b":1,"c":[{"d":"x"},{"d":null}]}}',), ('{"a":{"c":[{"d":"longer"}],"b":2.5}}',)]
    v = F.parse_json("j")
    found = spark.createDataFrame(rows, "j string").select(chat.field_paths(v).alias("p"), chat.fingerprint(v).alias("f")).collect()
    assert found[0].p == found[1].p == ["a.b", "a.c[].d"] and found[0].f == found[1].f
    odd = spark.createDataFrame([('{"x y":1,"q`t":{"<>,: ":[[1]]}}',)], "j string").select(chat.field_paths(v).alias("p")).first()
    assert odd.p == ["q`t.<>,: [][]", "x y"]


def test_ties_repeats_and_nothing(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "n"), (None, 0, "user", "x")]
    found = {r.conv_id: r for r in read(spark, rows)}
    assert (found[1].n_turns, found[1].turns_sha256) == digest([("assistant", "n"), ("user", "a"), ("user", "a"), ("user", "b")])[:2]
    assert found[None].n_turns == 1
    assert read(spark, []) == []


def test_a_long_conversation_streams(spark):
    rows = [(9, t, "assistant" if t % 2 else "user", f"text {t}") for t in range(25_000)]
    (r,) = read(spark, rows)
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digest([x[2:] for x in rows])


def test_columns_give_the_same_turns_as_json(spark):
    tables = {
        "prompt": [("Q", "A"), (None, "A")], "messages": [([("user", "Q"), ("assistant", None)],), ([],), (None,)],
        "from and value": [([("human", "Q"), ("gpt", "A")],)], "turn row": [(3, "user", "x"), (None, None, None)],
        None: [("a", "b")],
    }
    schemas = {
        "prompt": "prompt string, response string", "messages": "messages array<struct<role:string,content:string>>",
        "from and value": "conversations array<struct<`from`:string,value:string>>",
        "turn row": "turn long, role string, text string", None: "other string, more string",
    }
    for name, rows in tables.items():
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id long, {schemas[name]}")
        columns = [c for c in df.columns if c != "id"]
        json_rows = df.select("id", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))
        turns = chat.turns_of_columns(df, "id", columns)
        assert sorted(map(tuple, turns.collect()), key=str) == sorted(
            map(tuple, chat.canonical_turns(json_rows, "id", "json").collect()), key=str)
        assert {r.layout for r in turns.collect()} <= {name, None}


def test_records_without_turns_stay_out_of_the_digests(spark):
    rows = [(1, json.dumps({"prompt": "Q", "response": "A"})), (1, "no json"), (2, None)]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "id long, json string"), "id", "json")
    (r,) = chat.conversation_digests(chat.format_turns(turns, "id"), "id").collect()
    assert (r.id, r.n_turns, r.turns_sha256) == (1, *digest([("user", "Q"), ("assistant", "A")])[:2])


def test_a_turn_of_21_million_characters(spark):
    n = 21_000_000
    rows = spark.createDataFrame([(5, 0, "user", "q"), (5, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    long = rows.withColumn("text", F.when(F.col("turn") == 1, F.repeat("text", n)).otherwise(F.col("text")))
    turns = chat.turns_of_columns(long, "conv_id", ["turn", "role", "text"])
    (r,) = chat.conversation_digests(chat.format_turns(turns, "conv_id"), "conv_id").collect()
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digest([("user", "q"), ("assistant", "a" * n)])
    # As JSON the parser refuses it: that is an error, not an empty turn.
    records = long.select("conv_id", F.to_json(F.struct("turn", "role", "text")).alias("json"))
    with pytest.raises(Exception, match="cannot be parsed"):
        chat.canonical_turns(records, "conv_id", "json").collect()
