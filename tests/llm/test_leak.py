import re

from turnloom.llm.leak import CHARS, WORDS, leaked_items
from turnloom.llm.records import article_texts


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def chars(t):
    return "".join(c for c in (t or "").lower() if c.isalnum())


def brute(records, items):
    out = set()
    for key, text in records:
        w, c = words(text), chars(text)
        for item, lang, body in items:
            if lang == "zh":
                b = chars(body)
                hit = any(b[k : k + 18] in c for k in range(len(b) - 17))
            else:
                b = words(body)
                mine = {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
                hit = any(tuple(b[k : k + 10]) in mine for k in range(len(b) - 9))
            if hit:
                out.add((key, item))
    return out


def test_lengths_are_guaranteed():
    assert WORDS[0] + WORDS[1] - 1 == 10 and CHARS[0] + CHARS[1] - 1 == 18


def test_against_brute_force_on_the_tables(spark, sf):
    items = spark.read.parquet(f"{sf}/eval_items.parquet")
    listed = [(r.item_id, r.lang, r.text) for r in items.collect()]
    qa = spark.read.parquet(f"{sf}/qa_sample.parquet")
    got = [tuple(r) for r in leaked_items(qa, items, "qa_id", "question").collect()]
    assert len(got) == len(set(got)) and set(got) == brute({(r.qa_id, r.question) for r in qa.collect()}, listed)
    articles = article_texts(spark.read.parquet(f"{sf}/en_article_tail500.parquet"))
    got = {tuple(r) for r in leaked_items(articles, items, "art_id", "text").collect()}
    assert got == brute([(r.art_id, r.text) for r in articles.collect()], listed)


def test_exact_lengths_and_edges(spark):
    ten = "One two, three FOUR five six seven eight nine ten"
    zh = "依第98则重量由黄转褐早于庚盘量杯倾倒值夜"
    items = spark.createDataFrame([(1, "en", f"x {ten} y", 0), (2, "zh", zh, 0), (3, "en", None, 0), (4, "en", "short", 0), (5, "en", ten, 0)], "item_id bigint, lang string, text string, rec_id int")
    rows = [
        (1, "... one-two three four\nfive six  seven eight nine ten!"), (2, "one two three four five six seven eight nine"), (3, f"前面，{zh[:18]}。"), (4, f"前面{zh[:17]}"),
        (5, None), (6, ""), (1, "... one-two three four\nfive six  seven eight nine ten!"), (7, " ".join(["filler"] * 50_000) + " " + ten + " " + ten), (None, ten),
    ]
    df = spark.createDataFrame(rows, "rec_id bigint, text string")
    for size in (32 << 20, 8):  # one block of items, and a block for nearly each
        got = sorted(tuple(r) for r in leaked_items(df, items, "rec_id", "text", block_bytes=size).collect())
        assert got == [(1, 1), (1, 5), (3, 2), (7, 1), (7, 5)]
    assert leaked_items(df.limit(0), items, "rec_id", "text").count() == 0
    assert leaked_items(df, items.limit(0), "rec_id", "text").count() == 0


def test_articles_take_each_line_once(spark):
    rows = [(1, 9, 2, "b", "en"), (2, 9, 1, "a", "en"), (1, 9, 2, "b", "en"), (3, 9, 3, None, "en"), (4, None, 1, "z", None)]
    df = spark.createDataFrame(rows, "line_id bigint, art_id bigint, line_no int, text string, lang string")
    assert [(r.art_id, r.text, r.lang) for r in article_texts(df).collect()] == [(9, "a b ", "en")]
