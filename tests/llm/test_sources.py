from turnloom.llm.langid import fit_languages, language_segments
from turnloom.llm.queries import _labelled, p2_languages, p2_segments


def test_all_sources(spark, sf):
    """Each record of the three tables once, with a language where it has one; segments for all that have."""
    keys = {(src, r[0]) for src, key, rows in _labelled(spark, sf) for r in rows.select(key).where(f"{key} is not null").collect()}
    got = p2_languages(spark, sf).collect()
    assert len(got) == len(keys) and {(r.src, r.rec_id) for r in got} == keys
    told = {(r.src, r.rec_id) for r in got if r.lang}
    assert {src for src, _ in told} == {"toolcall_dpo_zh_demo", "en_article_tail500", "documents"}
    segments = p2_segments(spark, sf).collect()
    assert {(r.src, r.rec_id) for r in segments} >= told and all(r.lang and 0 < r.confidence <= 1 for r in segments)


def test_text_without_a_whole_sentence(spark, sf):
    model = fit_languages(spark.read.parquet(f"{sf}/lang_reference.parquet"))
    text = "The clinic. The winter. The harbour. Before the door."
    df = spark.createDataFrame([(1, text), (2, "ab")], "id bigint, text string")
    got = language_segments(df, model, "id", "text").collect()
    assert [(r.id, r.start, r.stop, r.lang) for r in got] == [(1, 0, len(text), "en")]
