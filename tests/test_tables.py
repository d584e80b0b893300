import pytest
from pyspark.sql import functions as F

from turnloom.operators import quality as A
from turnloom.operators import ranking as K
from turnloom.operators import sampling as P
from turnloom.operators import tokens as T
from turnloom.operators import vocabulary as V
from turnloom.sources import readers as S
from turnloom.sources import writers as W
from turnloom.streaming import packed_stream, stream_text


def blocks(spark, texts, size, eos=2):
    df = spark.createDataFrame([(k, [ord(c) for c in t]) for k, t in enumerate(texts)], "k bigint, ids array<int>")
    return {r.block: (r.input_ids, r.n_docs) for r in T.packed_blocks(df, "k", "ids", size, eos).collect()}


def test_packing(spark):
    a, b = ord("a"), ord("b")
    assert blocks(spark, ["a", "b"], 10) == {0: ([a, 2, b, 2], 2)}  # less than a block: kept short
    assert blocks(spark, ["a", "b"], 4) == {0: ([a, 2, b, 2], 2)}
    assert blocks(spark, ["a", "b", "a"], 4) == {0: ([a, 2, b, 2], 2)}  # the rest is lost
    assert blocks(spark, ["", "aa"], 2) == {0: ([2, a], 2), 1: ([a, 2], 1)}
    assert blocks(spark, ["a\x02", "b"], 2) == {0: ([a, 2], 1), 1: ([b, 2], 1)}  # no second EOS


def test_packing_equals_one_list(spark):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(700)]
    flat = [x for t in texts for x in [*map(ord, t), 2]]
    got = blocks(spark, texts, 16)
    assert [got[k][0] for k in range(len(got))] == [flat[i : i + 16] for i in range(0, len(flat) // 16 * 16, 16)]


def test_supervised(spark):
    df = spark.createDataFrame([(1, 0, "a" * 30, "b" * 10), (1, 1, "cc", "dd"), (2, 0, "", ""), (3, 0, "x" * 3, "y" * 3), (3, 1, "z" * 18, "w" * 18)], "conv_id int, pair int, question string, answer string")
    e = T.supervised_lengths(df, 20)
    assert sorted((r.conv_id, r.pair, len(r.src), len(r.tgt)) for r in e.collect()) == [(1, 0, 15, 4), (2, 0, 0, 0), (3, 0, 3, 3)]
    rows = {r.conv_id: r for r in T.supervised_rows(e).collect()}
    assert rows[3].labels == [-100] * 3 + [ord("y")] * 3 + [2] and rows[3].input_ids == [ord("x")] * 3 + [ord("y")] * 3 + [2] and rows[2].labels == [2]
    assert {r.conv_id for r in P.some_label(T.supervised_rows(e)).collect()} == {1, 2, 3}
    assert T.special_tokens("<|im_end|>") == {"eos": "<|im_end|>", "bos": "<|im_end|>", "pad": "<|im_end|>"}


def test_padding(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "i array<int>")
    assert [r[0] for r in df.select(T.padded(F.col("i"), 2)).collect()] == [[1, 2], [0, 0]]
    assert [r[0] for r in df.select(T.padded_to_multiple(F.col("i"), 4, 9)).collect()] == [[1, 2, 3, 9], []]
    assert [r[0] for r in df.select(T.padding_mask(F.col("i"), 4)).collect()] == [[1, 1, 1, 0], [0, 0, 0, 0]]
    assert [r[0] for r in df.select(T.bordered_blocks(F.col("i"))).collect()] == [[2], []]
    assert [r[0] for r in spark.createDataFrame([("a😀",)], "t string").select(T.code_points(F.col("t"))).collect()] == [[97, 0x1F600]]


def test_places_do_not_follow_the_partitioning(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500 - 250).alias("k"))
    for parts in (1, 7):
        got = P.ranked(df.repartition(parts), "k").collect()
        assert all(r.place == r.k + 250 for r in got) and len(got) == 500
    a, b = ({r.k for r in P.sample_n(df.repartition(n), 20, "k").collect()} for n in (1, 5))
    assert a == b and len(a) == 20
    assert P.ranked(df.limit(0), "k").count() == 0


def test_rounding():
    assert [P.rounded(536, 1, how) for how in ("nearest", "down", "up")] == [5, 5, 6]


def test_groups_need_their_last_line(spark):
    df = spark.createDataFrame([(k, None if k % 2 else f"t{k}") for k in range(20)], "k int, t string")
    got = P.shuffled_groups(df, "k", "t").collect()
    assert all(r.texts.splitlines()[-1].startswith("5. ") for r in got) and all("None" not in r.texts for r in got)


def test_validation(spark):
    good = '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": ""}]}'
    lines = [good, "{bad", "", '{"x": 1}', '{"conversations": {}}', '{"conversations": [{"from": "human"}]}', '{"conversations": [{"from": "function_call", "value": "v"}]}', '{"conversations": []}']
    df = spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "k int, value string")
    checked = A.validated(df)
    assert [r.error for r in checked.orderBy("k").collect()] == [None, "no JSON", "no JSON", "no conversations", "conversations is no list", "item without from or value", "unknown role", None]
    assert tuple(A.validation_report(checked).first()) == (8, 2, 6)
    assert A.validated(df, roles=("human", "function_call")).where("k = 6").first().error is None


def test_metrics(spark):
    df = spark.createDataFrame([(1000.0, 0.0), (0.0, 1000.0)], "c double, r double")
    assert [r[0] for r in df.select(A.pairwise_log_loss(F.col("c"), F.col("r"))).collect()] == [0.0, 1000.0]
    assert tuple(A.squared_and_absolute_error(df, "c", "r").first()) == (1e6, 1e3)
    one = spark.createDataFrame([([5, 7, 9], [1, 5, 7]), ([1], [1])], "p array<int>, l array<int>")
    assert T.next_token_accuracy(one, "p", "l").first()[0] == 1.0


def test_rankings(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "vec_id int, embedding array<float>")
    q = vec.where("vec_id = 1").withColumnRenamed("vec_id", "query_id")
    assert [(r.vec_id, r.score) for r in K.similar_vectors(q, vec, 3).orderBy("nth").collect()] == [(1, 1.0), (2, 1.0), (3, 0.0)]
    docs = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, None), (4, "d")], "doc_id int, text string")
    asked = spark.createDataFrame([(9, "A c"), (8, "zzz")], "query_id int, text string")
    best = K.bm25(asked, docs, 2)
    assert [(r.query_id, r.doc_id) for r in best.orderBy("query_id", "nth").collect()] == [(9, 2), (9, 1)]
    shown = {r.query_id: (r.passages, r.message) for r in K.with_passages(asked, best, docs, none="none").collect()}
    assert shown == {9: (["a a c", "a b"], None), 8: ([], "none")}
    assert K.fused(best, best).count() == 2


def test_vocabularies(spark):
    lines = spark.createDataFrame([("一 1",), ("",), ("  b 2",), ("一 3",)], "value string")
    assert {r.piece for r in V.read_pieces(lines).collect()} == {"一", "b"}
    assert sorted(tuple(r) for r in V.read_frequencies(lines).collect()) == [("b", 2), ("一", 1), ("一", 3)]
    counts = spark.createDataFrame([("一", 9), ("二", 5), ("c", 7), ("三", 1)], "word string, freq bigint")
    got = {r.piece: r.source for r in V.merged(V.read_pieces(lines), spark.createDataFrame([("b",), ("x",)], "piece string"), counts, 3).collect()}
    assert got == {"一": "base", "b": "base", "x": "domain", "二": "words"}


def test_files(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text('{"conversations": [{"from": "human", "value": "一"}]}\n', encoding="utf-8")
    b.write_text('{"conversations": [], "tools": "[]"}\n', encoding="utf-8")
    rows = S.read_aligned(spark, [str(a), str(b)])
    assert rows.columns == ["conversations", "tools"] and [r.tools for r in rows.collect()] == [None, "[]"]
    assert S.read_jsonl(spark, str(tmp_path), S.SHAREGPT).count() == 2 and S.read_corpus(spark, str(tmp_path)).count() == 2
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.txt").write_text("x\n\ny\n")
    assert sorted(r.text for r in S.read_text(spark, str(tmp_path)).collect()) == ["", "x", "y"]
    assert sorted(r.text for r in S.read_text(spark, str(tmp_path), linebreaks=True).collect()) == ["\n", "x\n", "y\n"]
    with pytest.raises(ValueError):
        S.read_corpus(spark, str(tmp_path))
    (tmp_path / "arr.json").write_text('[{"a": 1}, {"a": 2}]')
    assert W.json_array_to_jsonl(spark, str(tmp_path / "arr.json"), str(tmp_path / "out")) == 2
    W.write_jsonl(spark.createDataFrame([("é", None)], "x string, y string"), str(tmp_path / "o2"), nulls=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "o2")).collect()] == ['{"x":"é","y":null}']
    (tmp_path / "seed.jsonl").write_text('{"system_prompt": "s"}\n{broken\n{"z": 1}\n')
    assert [r.system_prompt for r in S.read_seed_roles(spark, str(tmp_path / "seed.jsonl")).collect()] == ["s"]
    W.write_metrics(spark, {"loss": 1.5}, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().value == 1.5
    e = spark.createDataFrame([(1, [1.0])], "id int, v array<float>")
    assert W.load_embeddings(spark, str(tmp_path), W.save_embeddings(e, str(tmp_path), "ff").rsplit("=", 1)[1]).count() == 1
    assert W.row_count_report(e) == "Converted 1 samples"


def test_documents(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Head\n\n* one **two**\n[link](http://x)\n")
    (tmp_path / "b.html").write_text("<html><script>x</script><p>A &amp; B</p><p>C</p></html>")
    (tmp_path / "c.txt").write_text(" t \n\n u")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {}
    for r in S.read_documents(spark, str(tmp_path), skip=True).where("not path like '%pdf'").orderBy("path", "line_no").collect():
        got.setdefault(r.path[-4:], []).append(r.text)
    assert got == {"a.md": ["Head", "one two", "link"], "html": ["A & B", "C"], ".txt"[-4:]: ["t", "u"]} or got == {"a.md": ["Head", "one two", "link"], "html": ["A & B", "C"], "c.txt"[-4:]: ["t", "u"]}


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.txt").write_text("abc\nde\n")
    stream = stream_text(spark, str(src)).withColumn("k", F.length("text").cast("bigint"))
    packed_stream(stream, "k", "text", 4, 2, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [r.input_ids for r in got] == [[100, 101, 2, 97]]


def test_small_projections(spark):
    from turnloom.operators import projections as J

    df = spark.createDataFrame([("train", [("user", "a", 1)], 5), ("test", [], 6)], "split string, items array<struct<role:string,content:string,x:int>>, n int")
    df.createOrReplaceTempView("named_rows")
    assert S.read_named(spark, "named_rows").count() == 2 and S.read_named(spark, "named_rows", "test").first().n == 6
    assert J.items_to_conversations(df).columns == ["split", "conversations", "n"] and J.only(df, "n").columns == ["n"]
    assert [tuple(m) for m in df.select(J.as_messages(F.col("items")).alias("m")).first().m] == [("user", "a")]
    assert df.where(J.ends_with_assistant(F.col("items"))).count() == 0
    assert df.select(*W.predictions(F.col("split"), F.col("n"))).columns == ["Input", "Output"]
    assert J.aligned(df, {"n": "bigint", "new": "string"}).dtypes == [("n", "bigint"), ("new", "string")]
    assert df.select(J.attention_mask(F.col("items")).alias("m")).first().m == [1]


def test_raw_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n  \n{broken\n')
    assert S.read_raw_jsonl(spark, str(tmp_path / "x.jsonl")).count() == 3
    assert S.read_lines(spark, str(tmp_path / "x.jsonl"), blank=False).count() == 2


def test_shards_hold_every_row_once(spark):
    got = P.sharded(spark.range(100), 4, "id").collect()
    assert len(got) == 100 and {r.shard for r in got} == {0, 1, 2, 3}
