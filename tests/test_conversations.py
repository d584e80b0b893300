import random

import pytest

from turnloom.operators import conversations as C
from turnloom.operators import rendering as R


def turns(spark, *convs):
    rows = [(k, i, r, t) for k, c in enumerate(convs) for i, (r, t) in enumerate(c)]
    return spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")


def said(word):
    names = {"u": "human", "a": "gpt", "s": "system", "o": "observation", "f": "function_call", "x": "tool"}
    return [(names[w[0]], w) for w in word.split()]


def pairs_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.conv_id, r.pair)):
        out.setdefault(r.conv_id, []).append((r.question, r.answer))
    return out


def model(conv, keep_open):
    """The fold, one turn after another."""
    out, asked = [], []
    for role, text in conv:
        if role in ("human", "observation"):
            asked.append(text)
        elif role in ("gpt", "function_call") and asked:
            out.append(("\n".join(asked), text))
            asked = []
    return out + ([("\n".join(asked), "")] if keep_open and asked else [])


def test_pairing_edges(spark):
    df = C.normalized_roles(turns(spark, said("u1 u2 a1 a2 u3 a3"), said("a0 u1 a1"), said("u1 a1 u2"), said("x1 u1 a1")))
    assert pairs_of(C.paired(df)) == {0: [("u1\nu2", "a1"), ("u3", "a3")], 1: [("u1", "a1")], 2: [("u1", "a1")], 3: [("u1", "a1")]}
    assert pairs_of(C.paired(df, keep_open=True))[2] == [("u1", "a1"), ("u2", "")]


@pytest.mark.parametrize("keep_open", [False, True])
def test_pairing_equals_the_fold(spark, keep_open):
    rng = random.Random(1)
    convs = [said(" ".join(rng.choice("uaofs") + str(i) for i in range(rng.randint(1, 9)))) for _ in range(200)]
    got = pairs_of(C.paired(C.normalized_roles(turns(spark, *convs)), keep_open))
    assert got == {k: p for k, c in enumerate(convs) if (p := model(c, keep_open))}


def test_last_system_turn_wins_and_falls_back(spark):
    df = turns(spark, said("s1 u1 s2"), said("u1"))
    fallback = spark.createDataFrame([(0, "other"), (1, "other")], "conv_id int, system_prompt string")
    assert {r.conv_id: r.system_prompt for r in C.system_prompts(df).collect()} == {0: "s2", 1: ""}
    assert {r.conv_id: r.system_prompt for r in C.system_prompts(df, fallback).collect()} == {0: "s2", 1: "other"}


def test_prefixes(spark):
    df = C.normalized_roles(turns(spark, said("u1 a1 u2 a2"), said("a0 u1 a1")))
    got = sorted((r.conv_id, [m.content for m in r.messages]) for r in C.prefixes(df).collect())
    assert got == [(0, ["u1", "a1"]), (0, ["u1", "a1", "u2", "a2"]), (1, ["a0", "u1", "a1"])]


def test_strict_alternation(spark):
    df = turns(spark, said("a1 u1 a2"), said("u1 a1 o1"), said("u1 u2 a1"), said("u1 a1 u2"), said("s1 u1"))
    assert pairs_of(C.strictly_alternating(df)) == {0: [("u1", "a2")], 1: [("u1", "a1")]}


def test_carrying_forward(spark):
    df = turns(spark, said("u1 a1 a2"), said("a3"))
    one = {(r.conv_id, r.question, r.answer) for r in C.carried_forward(df).collect()}
    both = {(r.conv_id, r.question, r.answer) for r in C.carried_forward(df, across=True).collect()}
    assert one == {(0, "u1", "a1"), (0, "u1", "a2")} and both == one | {(1, "u1", "a3")}


def test_delivered_twice_null_and_missing(spark):
    schema = "id int, conversations array<struct<`from`:string,value:string>>, turn string"
    df = spark.createDataFrame([(1, [("human", None), (None, "x")], "t"), (1, [("human", None), (None, "x")], "t"), (2, None, "t"), (3, [], "t")], schema)
    assert sorted(tuple(r) for r in C.to_turns(df, "id").collect()) == [(1, 0, "human", ""), (1, 1, "", "x")]
    assert C.paired(C.normalized_roles(C.to_turns(df.limit(0), "id"))).count() == 0


def test_react_history(spark):
    schema = "id int, messages array<struct<role:string,content:string,tool_calls:struct<name:string,arguments:string>>>"
    call = ("f", '{"a": 1}')
    rows = [
        (1, [("system", "\nsys ", None), ("user", "q1", None), ("assistant", "thinking", call), ("function", "42", None), ("assistant", "done", None), ("user", "q2", None)]),
        (2, [("assistant", "x", None), ("user", "q", None)]), (3, [("system", "s", None)]), (4, [("user", "a", None), ("function", "b", None)]), (5, [("user", "a", None), ("user", "b", None)]), (6, [("user", "a", None), ("boss", "b", None)]),
        (7, [("user", "a", None), ("assistant", "", call), ("function", "r", None)]),
    ]
    got = {r.id: r for r in C.react_history(spark.createDataFrame(rows, schema), instruction="USE TOOLS", tools=True).collect()}
    assert got[1].query == "q2" and got[1].system == "sys" and got[1].error is None
    assert [tuple(p) for p in got[1].history] == [("USE TOOLS\n\nQuestion: q1", 'Thought: thinking\nAction: f\nAction Input: {"a": 1}\nObservation: 42\nThought: I now know the final answer.\nFinal Answer: done')]
    assert [got[k].error for k in (2, 3, 4, 6)] == ["assistant before user", "no user message", "function before assistant", "unknown role boss"]
    assert got[5].error == "roles do not alternate"
    assert got[7].query is None and got[7].history[0].answer.endswith("\nObservation: r\nThought:")


def test_transcript(spark):
    df = spark.createDataFrame([(1, "患者：你好\n护士： 您好，患者\n旁白\n护士:再见")], "id int, text string")
    got = sorted((r.turn, r.role, r.text) for r in C.transcript_turns(df, "id", "text").collect())
    assert got == [(0, "human", "你好"), (1, "gpt", " 您好，患者"), (3, "gpt", "再见")]


def test_rendering(spark):
    pairs = spark.createDataFrame([(1, 0, "a{b}$1", "x"), (1, 1, "c", "y")], "conv_id int, pair int, question string, answer string")
    got = R.rendered_prompts(R.rendered_segments(pairs, "alpaca")).first().prompt
    t = R.template("alpaca")
    assert got == t.system_prompt + t.sep + t.prompt.replace("{query}", "a{b}$1") + "x" + t.sep + t.prompt.replace("{query}", "c") + "y"
    own = spark.createDataFrame([(1, "mine")], "conv_id int, system_prompt string")
    assert R.rendered_prompts(R.rendered_segments(pairs, "base", own)).first().prompt == "mine</s>a{b}$1x</s>cy"
    with pytest.raises(KeyError):
        R.template("no such template")
    assert "{content}" in R.template("deepseekcoder", strict=True).prompt and len(R.TEMPLATES) == 33


def test_rag_prompt(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(["p1", "p2"], "q"), ([], "q")], "p array<string>, q string")
    full, none = (r[0] for r in df.select(R.rag_prompt(F.col("p"), F.col("q"), 1000)).collect())
    assert "p1\np2" in full and full.rstrip().endswith("q") and none is None
    assert "p1" not in df.select(R.rag_prompt(F.col("p"), F.col("q"), 10)).first()[0]
