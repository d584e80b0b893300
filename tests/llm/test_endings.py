import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm.endings import Counter64, Units, asked_bits, context_counts, count, questions, whole
from turnloom.llm.pairs import each_once, is_truncated


@pytest.fixture(scope="module")
def corpus(spark):
    """40,000 replies; ten of them end like nothing else."""
    text = F.when(F.col("id") % 4000 == 7, "榴莲核桃可以煮汤。").otherwise("饮食要清淡，平时少吃火锅。")
    rows = spark.range(40_000).select("id", text.alias("reply"))
    return rows.unionByName(rows.where("id % 4000 = 7"))


def _known(texts):
    c = Counter64()
    count(texts, c)
    c.compact()
    ids, n, stops = c.parts[0]
    return dict(zip(ids.tolist(), zip(n.tolist(), stops.tolist())))


def test_counts_of_all_replies(spark, corpus):
    """Every reply counts, and a reply of one key delivered twice counts once."""
    for text, want in (("汤", (10, 10)), ("清", (39_990, 0)), ("锅", (39_990, 39_990)), ("淡", (39_990, 0))):
        first = questions([text])[0][0]
        asked = spark.createDataFrame([(int(np.uint64(first).view(np.int64)),)], "id bigint")
        got = context_counts(each_once(corpus, "id", "reply"), "reply", asked).where(F.col("id") == asked.first().id).first()
        assert (got.n, got.stops) == want, text


def test_rare_ending_is_known(corpus):
    rows = each_once(corpus, "id", "reply")
    assert is_truncated("平时少吃火锅。榴莲核桃可以", rows, "reply") and not is_truncated("平时少吃火锅。榴莲核桃可以煮汤", rows, "reply")


def test_the_set_of_contexts_changes_no_result(spark, corpus):
    text = "平时少吃火锅。榴莲核桃可以"
    asked = [i for i in questions([text])[0] if i]
    exact = _known([r.reply for r in corpus.where("id % 97 = 7").collect()])
    df = spark.createDataFrame([(int(np.uint64(i).view(np.int64)),) for i in asked], "id bigint")
    assert len(asked_bits(df)) == 1 << 10
    found = {int(np.int64(r.id).view(np.uint64)): (r.n, r.stops) for r in context_counts(corpus.where("id % 97 = 7"), "reply", df).collect()}
    assert {i: found.get(i) for i in asked} == {i: exact.get(i) for i in asked}


def test_units():
    u = Units(["Don't stop, 12 mg.\n1. 忌辣", "", "a b"])
    assert u.text.tolist() == [0] * 6 + [2, 2] and u.nth.tolist() == [0, 1, 0, 1, 0, 1, 0, 1]
    assert u.stops.tolist() == [False, False, False, True, False, False, False, False] and u.closed.tolist() == [True] * 4 + [False] * 4


def test_cut_sentences_of_the_corpus(spark):
    """Replies of the table cut within a sentence, and the same without their last stop: what is told apart."""
    rows = spark.read.parquet("/root/testdata/sf0.01/qa_sample.parquet").where("answer like '%。' and length(answer) > 30").select("answer").distinct().collect()
    texts = sorted(r.answer for r in rows)
    known = _known(texts)
    held = [t for k, t in enumerate(texts) if k % 3 == 0]
    cut = []
    for k, t in enumerate(held):
        at = 12 + (k * 7919) % (len(t) - 16)
        while t[at - 1] in "。，、；\n" or t[at] in "。，、；\n" or t[at - 1].isdigit():
            at -= 1
        cut.append(t[:at])
    broken = [not whole(q, known) for q in questions(cut)]
    wrong = [not whole(q, known) for q in questions([t.rstrip("。") for t in held])]
    assert len(held) > 100 and sum(broken) >= 0.9 * len(held) and sum(wrong) <= 0.02 * len(held), (sum(broken), sum(wrong), len(held))


def test_nothing_to_count(spark):
    none = spark.createDataFrame([], "id bigint, reply string")
    assert not is_truncated("一二三四五六七八", none, "reply")
    assert questions(["", "...", "a."]) == [None, None, None]
