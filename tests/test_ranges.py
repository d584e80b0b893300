"""Splits, layouts and rankings where keys are hot, long or negative."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.operators import ranking as K
from turnloom.operators import sampling as P
from turnloom.operators import tokens as T
from turnloom.operators import vocabulary as V
from turnloom.operators.chunks import wide_spans


@pytest.mark.parametrize("few", [3, 50, 50_000])
def test_border_is_found_by_counting(spark, few, monkeypatch):
    monkeypatch.setattr(P, "FEW", few)
    keys = [5] * 300 + list(range(-200, 200))
    df = spark.createDataFrame([(o, k) for k, o in enumerate(keys)], "o bigint, k bigint").repartition(5)
    want = sorted((o, k) for k, o in enumerate(keys))
    for n in (1, 2, 199, 206, 350, 506, 507, 699, 700):
        assert tuple(P.border(df, F.col("o"), "k", n)) == want[n - 1], n
    assert P.border(df, F.col("o"), "k", 0) is None


def test_splits_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "FEW", 20)
    ids = [k * 7 - 900 for k in range(300)]
    df = spark.createDataFrame([(k, "x" * 60 + str(k)) for k in ids], "k bigint, s string").repartition(6)
    assert {r.k for r in P.head_split(df, "k", 10).where("split = 'validation'").collect()} == set(sorted(ids)[:30])
    assert {r.s for r in P.head_split(df, "s", 10).where("split = 'validation'").collect()} == set(sorted("x" * 60 + str(k) for k in ids)[:30])
    whole = df.withColumn("d", F.concat(P.shuffle_key("k"), F.lit(":"), F.col("k").cast("string"))).collect()
    want = {r.k for r in sorted(whole, key=lambda r: r.d)[:30]}
    assert {r.k for r in P.hash_holdout(df, "k", 10).where("split = 'validation'").collect()} == want
    assert P.head_split(df.limit(0), "k", 10).count() == 0 and P.hash_holdout(df.limit(0), "k", 10).count() == 0


def test_held_out(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    own = spark.createDataFrame([(100,)], "k bigint")
    assert sorted((r.k, r.split) for r in P.held_out(df, "k", 50, own).collect())[-1] == (100, "validation")
    assert P.held_out(df, "k", 50, own).where("split = 'validation'").count() == 1
    assert P.held_out(df, "k", 50, own.limit(0)).where("split = 'validation'").count() == 10


@pytest.mark.parametrize("keys", [[-12, -3, 0, 5, 70, 800], ["a", "ab", "b" * 40, "b" * 41, "c", "ca"]])
def test_packing_follows_the_key(spark, keys):
    df = spark.createDataFrame([(k, [10 * n + 1, 10 * n + 2]) for n, k in enumerate(keys)], ["k", "ids"]).repartition(4)
    blocks = {r.block: r.input_ids for r in T.packed_blocks(df, "k", "ids", 6, 0).collect()}
    flat = [x for n in range(len(keys)) for x in (10 * n + 1, 10 * n + 2, 0)]
    assert blocks == {b: flat[6 * b : 6 * b + 6] for b in range(3)}


def test_nearest_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "TILE", 50)
    monkeypatch.setattr(K, "BLOCK_BYTES", 200)
    r = np.random.default_rng(3)
    rows = [(k, r.normal(size=4).round(2).tolist()) for k in range(60)]
    rows += [(60, None), (61, [0.0] * 4), (62, [1.0]), (63, rows[5][1]), (64, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    q = df.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(x.query_id, x.nth): (x.vec_id, x.score) for x in K.similar_vectors(q, df, 3).collect()}
    good = [(k, np.array(v)) for k, v in rows if v and len(v) == 4 and any(v)]
    for k, v in good:
        if k % 5 == 0:
            best = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6), i) for i, w in good)[:3]
            assert [got[k, n] for n in (1, 2, 3)] == [(i, -s) for s, i in best]
    assert {k for k, _ in got} == {k for k, _ in good if k % 5 == 0}
    assert K.similar_vectors(q.limit(0), df, 3).count() == 0 and K.similar_vectors(q, df.limit(0), 3).count() == 0


def test_segmenters(spark):
    df = spark.createDataFrame([(1, "我们去ab医院，好"), (2, None)], "doc_id bigint, text string")
    assert df.select(K.words_and_pairs(F.col("text"))).first()[0] == ["我们", "们去", "ab", "医院", "好"]
    assert {r.word for r in V.word_counts(df, "text", lambda t: F.split(t, "，")).collect()} == {"我们去ab医院", "好"}
    asked = spark.createDataFrame([(7, "哪家医院")], "query_id bigint, text string")
    assert K.bm25(asked, df).count() == 0 and K.bm25(asked, df, segment=K.words_and_pairs).first().doc_id == 1
    assert wide_spans("一二三四五六", 3, 0, lambda t: [t[k : k + 2] for k in range(0, len(t), 2)]) == ["一二三四", "五六"]


def test_frequencies_in_order(spark):
    lines = spark.createDataFrame([(1, "b 2"), (2, "a 9"), (3, "c 2"), (4, "x"), (5, "d y")], "n int, value string")
    assert [tuple(r) for r in V.read_frequencies(lines, line_no="n").collect()] == [("a", 9), ("b", 2), ("c", 2)]


def test_equality_of_ones_own(spark):
    from turnloom.functions.text import accuracy_reward

    df = spark.createDataFrame([("<answer>1/2</answer>", "0.5"), ("<answer>1/3</answer>", "0.5")], "r string, g string")
    half = lambda a, b: (a == "1/2") & (b == "0.5")
    assert [r[0] for r in df.select(accuracy_reward("r", "g", half)).collect()] == [1.0, 0.0]


def test_missing_library_is_an_error(spark, tmp_path):
    from turnloom.sources.readers import read_documents

    (tmp_path / "d.docx").write_bytes(b"PK")
    with pytest.raises(Exception, match="docx"):
        read_documents(spark, str(tmp_path)).collect()
    assert read_documents(spark, str(tmp_path), skip=True).count() == 1


def test_carried_over_ranges(spark):
    from turnloom.operators.conversations import carried_forward

    rows = [(c, t, "human" if c % 9 == 0 and t == 0 else "gpt", f"{c}.{t}") for c in range(2, 90) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").repartition(5)
    want, last = [], None
    for c, t, role, text in sorted(rows):
        last = text if role == "human" else last
        if role == "gpt" and last is not None:
            want.append((c, t, last, text))
    assert sorted(tuple(r) for r in carried_forward(df, across=True).collect()) == want
