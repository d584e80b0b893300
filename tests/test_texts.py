import pytest
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.functions import tools as TL
from turnloom.functions.checks import DistillationOptions, check_model_length, require_columns
from turnloom.operators import chunks as CH


def of(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize("value", ["", " ", "　a \t b ", "\x1c x\x1f", "a ", "\n\na\r\n", "x"])
def test_strip_is_that_of_python(spark, value):
    assert of(spark, value, X.strip) == value.strip()
    assert of(spark, value, X.normalized) == " ".join(value.lower().split())


def test_format_reward(spark):
    good = "<think>a</think><answer>b</answer>"
    assert [of(spark, v, X.format_reward) for v in (good, good + "\n", "x" + good, "<think>a\nb</think><answer>c</answer>", None)] == [1.0, 1.0, 0.0, 0.0, 0.0]


def test_extracted_answer(spark):
    assert [of(spark, v, X.extracted_answer) for v in ("<answer> a\n</answer><answer>b</answer>", " plain ", None)] == ["a", "plain", ""]


def test_boxes(spark):
    cases = {"x \\boxed{a{b}c} y": ("\\boxed{a{b}c}", "a{b}c"), "\\boxed{a": (None, None), "v \\boxed 7$ z": ("\\boxed 7", "7"), "\\fbox{x}": ("\\fbox{x}", None), "none": (None, None), "\\boxed{1} \\boxed{2}": ("\\boxed{2}", "2")}
    for text, (box, inside) in cases.items():
        assert (of(spark, text, X.boxed), of(spark, text, X.boxed_solution)) == (box, inside), text


def test_chinese(spark):
    for text, every, some in (("", True, False), ("一", True, True), ("a一", False, True), ("龦", False, True), ("一\n", False, True)):
        assert (of(spark, text, X.all_chinese), of(spark, text, X.has_chinese)) == (every, some)


def test_accuracy(spark):
    df = spark.createDataFrame([("<answer>1,000</answer>", "so #### 1000.0"), ("x", "y"), ("Paris", " paris "), (None, "y"), ("", "")], "r string, g string")
    assert [r[0] for r in df.select(X.accuracy_reward("r", "g")).collect()] == [1.0, 0.0, 1.0, 0.0, 0.0]


def test_stops(spark):
    assert of(spark, "a STOP b STOP", lambda c: X.cut_at_stop(c, "STOP")) == "a "
    df = spark.createDataFrame([(["\nx", "x", "\n", "\n\ny"],)], "s array<string>")
    assert df.select(X.expanded_stops("s")).first()[0] == ["\nx", "x", "\n", "\n\ny", "y"]
    ids = spark.createDataFrame([(list(range(10)),)], "i array<int>")
    assert ids.select(X.keep_last("i", 15, 4)).first()[0] == [7, 8, 9] and ids.select(X.keep_last("i", 4, 4)).first()[0] == []


def test_numbers_and_perplexity(spark):
    assert of(spark, "1. a\n\n\n\n2. b. c\n\nplain", X.numbered_items) == ["a", "b. c", "plain"]
    assert spark.range(1).select(X.perplexity(F.lit(1000.0))).first()[0] == float("inf") and X.rope_factor(4097, 2048) == 3.0


TOOLS = [{"name": "w", "description": "weather", "parameters": {"type": "object", "properties": {"city": {"type": "string", "description": "the city"}, "unit": {"type": "string", "description": "u", "enum": ["c", "f"]}, "days": {"type": "array", "description": "d", "items": {"type": "int"}}}, "required": ["city"]}}]


def test_tools_text():
    text = TL.tools_text(TOOLS, "default")
    assert "> Tool Name: w\nTool Description: weather\nTool Args:\n  - city (string, required): the city\n  - unit (string): u, should be one of [c, f]\n  - days (array): d, where each item should be int\n\n" in text
    assert "one of [w])" in text and '```{"input": "hello world", "num_beams": 5}```' in text
    assert TL.tools_text(TOOLS, "mistral").startswith('[AVAILABLE_TOOLS] [{"type": "function", "function": {"name": "w"') and "Today Date: 01 Jan 2024" in TL.tools_text(TOOLS, "llama3", "01 Jan 2024")
    assert TL.tools_text(TOOLS, "qwen3") == TL.tools_text(TOOLS, "qwen") and "## w\n\n{\n    \"name\"" in TL.tools_text(TOOLS, "glm4")
    with pytest.raises(ValueError):
        TL.dialect("other")


@pytest.mark.parametrize("kind", TL.DIALECTS)
def test_calls_there_and_back(spark, kind):
    calls = [("f", '{"a": "é", "n": [1, 2]}')] + ([("g", '{"b": {}}')] if kind not in ("glm4", "llama3") else [])
    df = spark.createDataFrame([([{"name": n, "arguments": a} for n, a in calls],)], "c array<struct<name:string,arguments:string>>")
    text = df.select(TL.format_calls(F.col("c"), kind).alias("t"))
    got = text.select(TL.extract_calls(F.col("t"), kind).alias("x")).first().x
    assert got.is_call and [tuple(c) for c in got.calls] == calls
    many = spark.createDataFrame([([{"name": "f", "arguments": "{}"}] * 2,)], "c array<struct<name:string,arguments:string>>")
    assert (many.select(TL.format_calls(F.col("c"), kind)).first()[0] is None) == (kind in ("glm4", "llama3"))


def test_calls_that_are_none(spark):
    assert TL.calls_in('Action: a\nAction Input: {"x": 1}\nAction: b\nAction Input: {broken', "default") is None
    assert TL.calls_in("plain", "qwen") is None and TL.calls_in("[]", "mistral") is None
    assert TL.calls_in('Action: a\nAction Input: "```{"x": 1}```"', "default") == [("a", '{"x": 1}')]


def test_call_values_and_observations(spark):
    assert of(spark, '{"name": "f", "arguments": {"a": 1}}', lambda c: TL.format_call_value(c, None)) == 'Action: f\nAction Input: {"a": 1}'
    assert of(spark, '{"other": 1}', lambda c: TL.format_call_value(c, "qwen")) == '{"other": 1}' and of(spark, "{no", lambda c: TL.format_call_value(c, "qwen")) is None
    shown = [of(spark, "v", lambda c, k=k, a=a: TL.format_observation(c, k, a)) for k, a in (("qwen3", True), ("qwen3", False), ("glm4", True), ("llama3", True), (None, True))]
    assert shown == ["<tool_response>\nv\n</tool_response>", "Observation: v", "<|observation|>\nv", "Observation: v", "Observation: v"]


def test_react(spark):
    assert tuple(of(spark, "Thought: I look\nAction: f \nAction Input: {1}\nObservation: no", TL.react_parts)) == ("I look", "f", "{1}")
    assert tuple(of(spark, "x\nFinal Answer: 7", TL.react_parts)) == ("7", None, None) and tuple(of(spark, "x", TL.react_parts)) == ("x", None, None)
    text = TL.react_instruction([{"name": "a"}, {"name": "b", "name_for_model": "bb", "parameters": {"x": 1}}])
    assert "one of [a, bb]" in text and text.endswith("Begin!") and 'Parameters: {"x": 1}' in text


def test_sentence_chunks(spark):
    t = "One two. " + "x" * 40 + "! Three? four."
    assert of(spark, t, lambda c: CH.sentence_chunks(c, 20)) == ["One two.", "x" * 40 + "!", "Three? four."]
    assert of(spark, t, lambda c: CH.overlapped(CH.sentence_chunks(c, 20), 3)) == ["One two. xxx", "x" * 40 + "! Thr", "Three? four."]
    assert of(spark, "one", lambda c: CH.overlapped(CH.sentence_chunks(c, 20), 3)) == ["one"] and of(spark, "a. b", lambda c: CH.overlapped(CH.sentence_chunks(c, 2), 0)) == ["a.", "b"]


def fold(text, size, overlap):
    out, cur = [], ""
    for ch in text:
        if len(cur) + 1 > size:
            out.append(cur)
            cur = ch
        else:
            cur += ch
        if ch in "。！？\n" and len(cur) > size - overlap:
            out.append(cur)
            cur = ""
    return out + ([cur] if cur else [])


def test_wide_chunks_equal_the_fold():
    import random

    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("一二三四五六七。！") for _ in range(rng.randint(0, 120)))
        for size, overlap in ((20, 5), (7, 7), (9, 0), (10, 3)):
            assert CH.wide_spans(t, size, overlap) == fold(t, size, overlap), (t, size, overlap)


def test_lines_merge_to_closing_characters(spark):
    df = spark.createDataFrame([(1, 1, " a "), (1, 2, "b."), (1, 3, ""), (1, 4, "c"), (2, 1, "d）")], "p int, n int, t string")
    assert sorted((r.p, r.text) for r in CH.merged_lines(df, "p", "n", "t").collect()) == [(1, "ab."), (1, "c"), (2, "d）")]


def test_checks(spark):
    for bad in ({"lmbda": 1.5}, {"beta": -0.1}, {"max_prompt_length": 0}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            DistillationOptions(**bad)
    with pytest.raises(ValueError):
        check_model_length(10)
    with pytest.raises(ValueError, match="nope"):
        require_columns(spark.range(1), "nope")


def test_a_dialect_of_ones_own(spark):
    TL.register_dialect("mine", lambda tools: " ".join(t["name"] for t in tools), lambda text: [(text[1:], "{}")] if text.startswith("!") else None)
    df = spark.createDataFrame([('[{"name": "a"}]', "!f"), (None, "x")], "tools string, reply string")
    assert [r[0] for r in df.select(TL.tools_prompt(F.col("tools"), "mine")).collect()] == ["a", None]
    got = [r[0] for r in df.select(TL.extract_calls(F.col("reply"), "mine")).collect()]
    assert (got[0].is_call, got[0].calls[0].name, got[1].text) == (True, "f", "x")
    del TL.OWN["mine"]
