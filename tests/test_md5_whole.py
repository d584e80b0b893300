import hashlib

from turnloom.plans.texts import text_md5


def test_texts_that_differ_late(spark, tmp_path):
    texts = ["a" * 64 + "b", "a" * 64 + "c", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.hash for r in text_md5(spark, str(tmp_path)).collect()}
    assert got == {k: None if t is None else hashlib.md5(t.encode()).hexdigest() for k, t in enumerate(texts)}
