import json
import random

from pyspark.sql import functions as F

from tessera.llm import chat_format as c

HARD = ["", "\\", "\\b", "\\l", "<turn:user>", "</turn>", "</turn>\n", "<", ">", "</tur", "n>", "<turn:", "\\### Assistant: </turn> ok", "é\n\n", "x\\"]


def test_round_trip(spark):
    rng = random.Random(1)
    turns = [[(rng.choice(["user", "assistant", "a<b>\\"]), "".join(rng.choice(HARD) for _ in range(rng.randrange(5)))) for _ in range(rng.randrange(6))] for _ in range(200)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(turns)], f"conv_id int, turns {c.TURNS}")
    out = c.formatted(frame).select("turns", c.read_back(F.col("formatted")).alias("back"), c.loss_text(F.col("formatted"), F.col("loss")).alias("learned"))
    for r in out.collect():
        assert r.back == r.turns
        assert r.learned == "".join(t.text for t in r.turns if t.role == "assistant")


def test_layouts(spark):
    records = [
        {"prompt": "p", "response": "r"}, {"response": "r", "prompt": "p"}, {"instruction": "i", "input": "x", "output": "o"}, {"instruction": "i", "input": "", "output": "o"},
        {"messages": [{"role": "user", "content": "u"}, {"content": "a", "role": "assistant"}]}, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, {"other": 1}, {"messages": []},
    ]
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, "no json"), (91, None), (92, "[1]")], "i int, record string")
    got = {r.i: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in c.canonical_json(frame, "record").collect()}
    assert got[0] == got[1] == ("prompt_response", [("user", "p"), ("assistant", "r")])
    assert got[2] == ("instruction_input_output", [("user", "i\n\nx"), ("assistant", "o")]) and got[3][1][0] == ("user", "i")
    assert got[4] == ("messages", [("user", "u"), ("assistant", "a")]) and got[5] == ("from_value", [("user", "h"), ("assistant", "g")])
    assert all(got[i] == (None, None) for i in (6, 7, 90, 91, 92))


def test_further_and_clashing_fields(spark):
    records = [
        {"id": 7, "source": "s", "prompt": "p", "response": "r"}, {"prompt": "p", "response": "r", "system": "s", "meta": {"a": 1}}, {"prompt": "p", "completion": "c", "response": "r"},
        {"messages": [{"role": "user", "content": "u", "weight": 1}], "prompt": "p", "response": "r"}, {"messages": [], "prompt": "p", "response": "r"}, {"layout": "x", "question": "q", "answer": None},
    ]
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, record string").withColumns({"layout": F.lit(1), "turns": F.lit(2)})
    got = {r.i: (r.layout, [tuple(t) for t in r.turns]) for r in c.canonical_json(frame, "record").collect()}
    assert got[0] == ("prompt_response", [("user", "p"), ("assistant", "r")]) and got[1][0] == "system_prompt_response"
    assert got[2] == ("prompt_response", [("user", "p"), ("assistant", "r")]) and got[3] == ("messages", [("user", "u")])
    assert got[4][0] == "prompt_response" and got[5] == ("question_answer", [("user", "q"), ("assistant", "")])
    rows = spark.createDataFrame([(1, 0, "user", "q", "x", ["y"], "z")], "conv_id bigint, turn bigint, role string, text string, prompt string, messages array<string>, response string")
    assert [tuple(t) for t in c.canonical_rows(rows).first().turns] == [("user", "q")]


def test_typed_tables(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", None, 5), (1, 0, None, "q", 6), (1, None, "user", "first", 7), (None, 0, "user", "n", 8), (2, 0, "user", "d", 9), (2, 0, "user", "d", 9)], "conv_id bigint, turn bigint, role string, text string, extra int")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in c.canonical_rows(rows).collect()}
    assert got == {1: [("user", "first"), ("unknown", "q"), ("assistant", "")], None: [("user", "n")], 2: [("user", "d"), ("user", "d")]}
    assert c.canonical_rows(rows.limit(0)).count() == 0
    typed = spark.createDataFrame([([("user", "x")],)], "messages array<struct<role:string,content:string>>")
    assert [tuple(t) for t in c.canonical_rows(typed).first().turns] == [("user", "x")]


def test_many_turns_are_linear(spark):
    """A hundred thousand turns in one conversation: spans and loss text equal a plain loop's."""
    import time

    turns = [("user" if i % 2 == 0 else "assistant", f"\\ </turn> \U0001f389 {i}") for i in range(100_000)]
    frame = spark.createDataFrame([(1, turns), (2, []), (3, [("assistant", "")])], "i int, turns array<struct<role:string,text:string>>")
    began = time.perf_counter()
    out = c.formatted(frame)
    got = {r.i: r for r in out.select("i", "loss", "formatted", c.loss_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    assert time.perf_counter() - began < 20
    assert got[1].learned == "".join(text for role, text in turns if role == "assistant")
    assert len(got[1].loss) == 50_000 and all(got[1].formatted[a:b].startswith("\\b \\l/turn> \U0001f389 ") for a, b in got[1].loss[-3:])
    assert (got[2].learned, got[2].formatted, got[3].learned, [tuple(x) for x in got[3].loss]) == ("", "", "", [(16, 16)])
