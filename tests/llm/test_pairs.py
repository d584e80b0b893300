import pytest

from turnloom.llm.langid import fit_languages
from turnloom.llm.pairs import asked_languages, body_of, broken_call, broken_replies, common, copies, each_once, is_copy, is_empty
from turnloom.llm.refusals import is_refusal


@pytest.fixture(scope="module")
def corpus(spark):
    qa = spark.read.parquet("/root/testdata/sf0.01/qa_sample.parquet")
    return each_once(qa, "qa_id", "answer").withColumnRenamed("answer", "reply").cache()


@pytest.fixture(scope="module")
def model(spark, sf):
    return fit_languages(spark.read.parquet(f"{sf}/lang_reference.parquet"))


def test_empty():
    for t in (None, "", " \t\n", "​﻿", "...", "……", "N/A", "null", "无", "暂无回答", "<br>", "<p>&nbsp;</p>", "-", '""', "[]", "NaN", "？"):
        assert is_empty(t), t
    for t in ("无需用药", "骨科", "3", "No.", "yes"):
        assert not is_empty(t), t


def test_refusals():
    for t in ("很抱歉，这类内容我不便讨论。", "我无法回答这个问题，如有其他需要请随时告诉我。", "I'm sorry, but I can't help with that.", "恕难从命！", "亲，作为人工智能助手，我没有资格对此作出判断，请咨询专业人士。", "I cannot answer that. Please consult a professional."):
        assert is_refusal(t), t
    for t in ("抱歉回复晚了。建议先到骨科做血常规，再决定要不要用药。", "虽然无法一概而论，但是可以这样理解：饮食以清淡为主，忌辣椒。", "As an AI I may miss details, yet here is a full answer. Try bed rest for ten days.", "不能自行停用药物。", "可能是偏头痛"):
        assert not is_refusal(t), t


def test_copies():
    q = "请问舌根僵硬有快两周了，体重掉了11斤，平常怎么调养比较好？"
    for t in (q, f"问：{q}", f"“{q}”", f"{q}\n{q}", q.replace("，", ""), q.replace("快", ""), q.upper()):
        assert is_copy(q, t), t
    for t in (f"您问的是：{q}\n建议先到骨科做血常规，再决定要不要用药。", "平常可以多喝水。", "舌根僵硬"):
        assert not is_copy(q, t), t


def test_calls():
    assert broken_call('Action: f\nAction Input: {"a": "b"}\n') is False
    for t in ('Action: f\nAction Input: {"a": "b', "Action: f\nAction Input:", "Action: f", 'Action: f\nAction Input: {"a"'):
        assert broken_call(t) is True, t
    assert broken_call("plain text") is None


def test_truncated(spark, corpus, model):
    broken = ("饮食以牛奶为主，忌菠菜。平时少吃火锅，可以适当吃些绿豆水和", "心态要放松，肠易激多数在（", "孕期不宜接触芎榆翠饮，更不要……", "1. 饮食以咖啡为主，忌芒果。\n2. ", "不能自行停用荆蒲白根，否则，", "单靠热敷无法根治贫血，还要配合霞苍槲藤。从您的描述看，舌根发麻多半")
    sound = ("饮食以牛奶为主，忌菠菜", "心态要放松，偏头痛多数在29周内好转。祝早日康复", "胸片（空腹）", "骨科", "可能是偏头痛", "从您的描述看，舌根发麻多半和贫血有关", "1.热敷 2.冰敷 3.少吃牛奶", "A pinched nerve", "Likely migraine")
    prompt = "Frage: Was hilft gegen Kopfschmerzen, wenn man nachts nicht schlafen kann?"
    rows = [(k, "a", prompt, t) for k, t in enumerate(broken + sound)]
    df = spark.createDataFrame(rows, "rec_id bigint, fld string, prompt string, reply string")
    got = {r.rec_id for r in broken_replies(df, model, corpus=corpus).collect() if r.defect == "truncated"}
    assert got == set(range(len(broken)))


def test_body():
    for t, want in (("好转。祝早日康复", "好转。"), ("胸片（空腹）", "胸片"), ("好的 👍🏽", "好的"), ("慢走:-)", "慢走"), ("Rest well. Take care", "Rest well."), ("祝愿", "祝愿"), ("~", "~")):
        assert body_of(t) == want, t


# Worded for this test.
PLACEHOLDERS = (
    "no response yet", "(no answer given)", "answer pending", "待填写", "尚未回复", "<answer>", "[insert response here]", "To be added.", "content missing", "—— ——", "暂无相关资料", "此处填写答案", "目前没有数据", "undefined", "**TODO**", "null;",
    "Sin respuesta", "未回答", "请补充", "Not provided", "<div></div>", "&nbsp;&nbsp;", "🙂", "```", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod", "response: ", "¿?", "pas de réponse", "TBA", "(blank)",
)
REPLIES = ("无需用药", "骨科", "3", "No.", "yes", "没有问题", "没有关系", "空腹", "Not before Monday", "no fever", "None of these tablets", "a", "见医生", "Data show no effect.", "无糖", "待产")


def test_placeholders_of_own_wording():
    missed = [t for t in PLACEHOLDERS if not is_empty(t)]
    assert len(missed) <= 0.1 * len(PLACEHOLDERS), missed
    assert [t for t in REPLIES if is_empty(t)] == []


def _swapped(text: str, every: int) -> str:
    out = list(text)
    for k in range(1, len(out) - 1, every):
        out[k], out[k + 1] = out[k + 1], out[k]
    return "".join(out)


def test_changed_copies(spark):
    """Questions with neighbouring letters swapped, letters dropped or added, repeated or framed; and answers."""
    qs = [r.question for r in spark.read.parquet("/root/testdata/sf0.001/qa_sample.parquet").where("length(question) > 24").orderBy("qa_id").collect()][:90]
    for change in (lambda q: _swapped(q, 12), lambda q: "".join(ch for k, ch in enumerate(q) if k % 9), lambda q: q[:9] + "嗯" + q[9:20] + "x " + q[20:], lambda q: f"{q} {q}", lambda q: f"You wrote: {q}", lambda q: f"你想知道：{q}", str.upper):
        found = copies(qs, [change(q) for q in qs])
        assert found.sum() >= 0.9 * len(qs), [q for q, f in zip(qs, found) if not f][:3]
    new = " 建议先到骨科做血常规，再决定要不要用药，平时注意休息。"
    assert not copies(qs, [q + new for q in qs]).any()
    grams = [{q[k : k + 3] for k in range(len(q) - 2)} for q in qs]
    other = [(q, qs[k - 1]) for k, q in enumerate(qs) if len(grams[k] & grams[k - 1]) < 0.4 * len(grams[k] | grams[k - 1])]  # the table has records that resemble
    assert len(other) > 60 and not copies([a for a, _ in other], [b for _, b in other]).any()


def test_common_is_the_longest_common_subsequence():
    import random

    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randrange(1, 90))] for _ in range(2))
        rows = [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for k, y in enumerate(b):
                row.append(rows[-1][k] + 1 if x == y else max(rows[-1][k + 1], row[k]))
            rows.append(row)
        assert common(a, b, len(b) // 2) == [rows[-1][-1], rows[-1][len(b) // 2]]


def test_asked():
    assert asked_languages("把这段译成法语。") == {"fr"} and asked_languages("Please translate into German: x") == {"de"}
    assert asked_languages("头疼怎么办") == set()


def test_one_defect_each(spark, corpus, model):
    zh, en = "请问头疼得睡不着应该去哪个科室看比较好？", "If stiffness in the calf lasts five weeks, the clinic in town can check for vertigo and for the thyroid."
    rows = [
        (1, "a", zh, None), (2, "a", zh, "恕难从命。"), (3, "a", zh, zh), (4, "a", zh, en), (5, "a", None, None), (6, "a", "请用英文回答我：" + zh, en), (7, "a", zh, "神经内科"), (8, "b", zh, 'Action: f\nAction Input: {"a'),
        (9, "b", zh, 'Action: f\nAction Input: {"a": "long enough english words in a call"}'), (1, "a", zh, None), (None, "a", zh, None), (10, "a", en, "平时少吃火锅，可以适当吃些绿豆水和咖啡。心态要放松，偏头痛多数在29周内好转。"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "rec_id bigint, fld string, prompt string, reply string, defect string")
    got = sorted(tuple(r) for r in broken_replies(df, model, corpus=corpus).collect())
    assert got == [(1, "a", "empty"), (2, "a", "refusal"), (3, "a", "copy"), (4, "a", "other_language"), (8, "b", "truncated"), (10, "a", "other_language")]
    assert broken_replies(df.limit(0), model).count() == 0
