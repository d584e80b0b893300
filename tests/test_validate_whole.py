from turnloom.operators.quality import validated
from turnloom.plans.corpus import jsonl_validate, validation_counts

BROKEN = {'{"conversations"': "no JSON", "{}": "no conversations", '{"conversations": 5}': "conversations is no list", '{"conversations": [{"from": "human"}]}': "item without from or value", '{"conversations": []}': None}


def test_broken_lines(spark):
    df = spark.createDataFrame([(line,) for line in BROKEN], "value string")
    assert {r.value: r.error for r in validated(df).collect()} == BROKEN


def test_every_record_is_checked(spark, tmp_path):
    """A broken conversation gets its own error, whatever its key."""
    good, bad = [("human", "a"), ("gpt", "b")], [("human", "a"), ("robot", "b")]
    rows = [(k, bad if k >= 7 else good) for k in range(14)] + [(14, None), (15, [("human", None)])]
    spark.createDataFrame(rows, "pref_id bigint, conversations array<struct<`from`:string,value:string>>").write.parquet(f"{tmp_path}/toolcall_dpo_zh_demo.parquet")
    got = {r.pref_id: r.error for r in jsonl_validate(spark, str(tmp_path)).collect()}
    assert got == {k: "unknown role" if k >= 7 else None for k in range(14)} | {14: "no conversations", 15: "item without from or value"}
    assert tuple(validation_counts(spark, str(tmp_path)).first()) == (16, 7, 9)
