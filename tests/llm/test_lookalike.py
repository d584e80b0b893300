import unicodedata
from collections import defaultdict

from turnloom.llm.lookalike import Rewriter, choose_representatives, consistent_form, look_alike_classes, same_reading_pairs


def rewriter(**counts):
    return Rewriter(choose_representatives(look_alike_classes(), counts))


def test_same_reading():
    f = rewriter()
    for a, b in [
        ("ｆｕｌｌ　１２", "full 12"), ("café", unicodedata.normalize("NFD", "café")), ("zero​wi­dth", "zerowidth"), ("a b c", "a b c"),
        ("рое", "poe"), ("Ｓtа́r", "Stár"), ("ﬁnd", "find"), ("⼈工", "人工"), ("がぎ", unicodedata.normalize("NFD", "がぎ")), ("x‑y", "x-y"), ("ραyο", "payo"), ("Ꭺlⲟe", "Aloe"), ("սոit", "unit"), ("ᴄoᴡ", "cow"), ("Ｏrg", "Οrg"), ("更", "更"),
    ]:
        assert f(a) == f(b), (a, b)


def test_reader_can_tell():
    f = rewriter()
    for a, b in [("uber", "über"), ("a1", "a7"), ("Abc", "abc"), ("l", "I"), ("0", "O"), ("x²", "x2"), ("a  b", "a b"), ("a\nb", "a b"), ("i", "l"), ("ノ", "/")]:
        assert f(a) != f(b), (a, b)


def test_classes_are_transitive_and_disjoint():
    classes = look_alike_classes()
    members = [m for v in classes.values() for m in v]
    assert len(members) == len(set(members))
    assert any({"a", "а", "ａ"} <= set(v) for v in classes.values())


def test_representative_is_the_most_frequent():
    f = rewriter(**{"，": 10, ",": 3})
    assert f("a,b") == "a，b"
    f = rewriter(**{"，": 3, ",": 10})
    assert f("a，b") == "a,b"


def test_pairs_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = [(1, "Ｈello wоrld"), (2, "Hello world"), (3, "Hello world"), (4, None), (5, "​ "), (6, " "), (7, ""), (8, "hello world"), (2, "Hello world")]
    df = docs.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    got = [tuple(r) for r in same_reading_pairs(df).collect()]
    f, groups = rewriter(), defaultdict(set)
    for r in df.collect():
        if r.text and f(r.text).strip():
            groups[f(r.text)].add((r.doc_id, r.text))
    want = {(a[0], b[0]) for g in groups.values() for a in g for b in g if a[0] < b[0] and a[1] != b[1]}
    assert set(got) == want and len(got) == len(want)
    assert {(1, 2), (1, 3)} <= want and (2, 3) not in want


def test_consistent_form_has_a_row_for_each_row(spark):
    df = spark.createDataFrame([(1, None, "f"), (2, "", "f"), (3, "ａ", "f")], "doc_id bigint, text string, form string")
    forms = {r.doc_id: r.form for r in consistent_form(df).collect()}
    assert forms[1] is None and forms[2] == "" and forms[3] in ("a", "ａ")
    assert consistent_form(df.limit(0)).count() == 0
    assert same_reading_pairs(df.limit(0)).count() == 0


def test_a_third_of_all_rows_is_one_text(spark):
    rows = [(k, "the hot text" if k % 3 == 0 else f"text {k}") for k in range(1500)] + [(9000, "the hоt text"), (9001, "ｔhe hot text")]
    got = {tuple(r) for r in same_reading_pairs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(k, v) for k in range(0, 1500, 3) for v in (9000, 9001)} | {(9000, 9001)}
