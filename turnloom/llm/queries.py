"""The queries of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.encode import encode_corpus
from turnloom.llm.lookalike import consistent_form, same_reading_pairs
from turnloom.llm.langid import document_languages, fit_languages, label_defects, language_segments
from turnloom.llm.leak import leaked_items
from turnloom.llm.neardup import near_groups, near_pairs
from turnloom.llm.packing import container_report, pack, token_counts
from turnloom.llm.pairs import broken_replies
from turnloom.llm.records import article_texts, human_text, last_human_turn
from turnloom.session import table


def _short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions and the human turns: ``src``, ``id``, ``text``."""
    q = table(spark, sf_dir, "qa_sample").select(F.lit("qa_sample").alias("src"), F.col("qa_id").alias("id"), F.col("question").alias("text"))
    c = table(spark, sf_dir, "toolcall_dpo_zh_demo").select(F.lit("toolcall_dpo_zh_demo").alias("src"), F.col("pref_id").alias("id"), human_text().alias("text"))
    return q.unionByName(c)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(_short_texts(spark, sf_dir))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_short_texts(spark, sf_dir))


def _labelled(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, DataFrame]]:
    """Source, key and rows with ``text`` and ``lang`` of all records with a language label."""
    turns = table(spark, sf_dir, "toolcall_dpo_zh_demo").select("pref_id", human_text().alias("text"), "lang")
    articles = article_texts(table(spark, sf_dir, "en_article_tail500"))
    return [("toolcall_dpo_zh_demo", "pref_id", turns), ("en_article_tail500", "art_id", articles), ("documents", "doc_id", table(spark, sf_dir, "documents"))]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_languages(table(spark, sf_dir, "lang_reference"))
    parts = [label_defects(rows, model, key, "text", "lang").select(F.lit(src).alias("src"), F.col(key).alias("rec_id"), "kind", "lang") for src, key, rows in _labelled(spark, sf_dir)]
    return reduce(DataFrame.unionByName, parts)


def _records(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    """Source and rows (``rec_id``, ``text``) of the same records, each key once; only ``pref_id`` comes twice."""
    parts = [(src, rows.select(F.col(key).alias("rec_id"), "text").where("rec_id is not null")) for src, key, rows in _labelled(spark, sf_dir)]
    return [(src, rows.dropDuplicates(["rec_id"]) if src == "toolcall_dpo_zh_demo" else rows) for src, rows in parts]


def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_languages(table(spark, sf_dir, "lang_reference"))
    return reduce(DataFrame.unionByName, [document_languages(rows, model, "rec_id", "text").select(F.lit(src).alias("src"), "*") for src, rows in _records(spark, sf_dir)])


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_languages(table(spark, sf_dir, "lang_reference"))
    return reduce(DataFrame.unionByName, [language_segments(rows, model, "rec_id", "text").select(F.lit(src).alias("src"), "*") for src, rows in _records(spark, sf_dir)])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items")
    questions = leaked_items(table(spark, sf_dir, "qa_sample"), items, "qa_id", "question")
    articles = leaked_items(article_texts(table(spark, sf_dir, "en_article_tail500")), items, "art_id", "text")
    return questions.select(F.lit("qa_sample").alias("src"), F.col("qa_id").alias("rec_id"), "item_id").unionByName(
        articles.select(F.lit("en_article_tail500").alias("src"), F.col("art_id").alias("rec_id"), "item_id")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa, tc = table(spark, sf_dir, "qa_sample"), table(spark, sf_dir, "toolcall_dpo_zh_demo")
    model = fit_languages(table(spark, sf_dir, "lang_reference"))
    asked = [F.lit("qa_sample").alias("src"), F.col("qa_id").alias("rec_id"), F.lit("answer").alias("fld"), F.col("question").alias("prompt"), F.col("answer").alias("reply")]
    both = F.explode(F.array(*(F.struct(F.lit(c).alias("fld"), F.col(c).alias("reply")) for c in ("chosen", "rejected"))))
    turns = tc.select(F.col("pref_id").alias("rec_id"), last_human_turn().alias("prompt"), both.alias("x")).select("rec_id", "x.fld", "prompt", "x.reply")
    chosen = turns.select(F.lit("toolcall_dpo_zh_demo").alias("src"), "rec_id", "fld", "prompt", "reply")
    both = qa.select(*asked).unionByName(chosen).withColumn("fld", F.concat_ws("/", "src", "fld"))  # the field within its table
    found = broken_replies(both, model)
    return found.select(F.split_part("fld", F.lit("/"), F.lit(1)).alias("src"), "rec_id", F.split_part("fld", F.lit("/"), F.lit(2)).alias("fld"), "defect")


def p5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents")))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container_report(p6_pack(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_reading_pairs(table(spark, sf_dir, "documents"))


def p7_consistent_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_form(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_languages, p2_segments, p3_found, p4_found, p5_ids, p6_pack, p6_containers, p7_found, p7_consistent_form)}


_RECORDS = """records AS (SELECT DISTINCT 'qa_sample' AS src, qa_id AS rec_id, question AS text FROM qa_sample WHERE question IS NOT NULL
UNION ALL SELECT 'en_article_tail500', art_id, string_agg(coalesce(text, ''), ' ' ORDER BY line_no, line_id) FROM (SELECT DISTINCT line_id, art_id, line_no, text FROM en_article_tail500 WHERE art_id IS NOT NULL) GROUP BY art_id)"""


def _grams(table: str, key: str, unit: str, n: int) -> str:
    """SQL of the different n-grams of words or characters of the texts of a table."""
    if unit == "words":
        own = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
        return f"SELECT DISTINCT {key}, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT {key}, {own} AS w FROM {table}))"
    own = r"regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')"
    return f"SELECT DISTINCT {key}, substr(w, i, {n}) AS g FROM (SELECT {key}, w, unnest(range(1, length(w) - {n - 2})) AS i FROM (SELECT {key}, {own} AS w FROM {table}))"


P1_SQL = f"""WITH t AS (SELECT DISTINCT 'qa_sample' AS src, qa_id AS id, question AS text FROM qa_sample WHERE question IS NOT NULL
UNION ALL SELECT DISTINCT 'toolcall_dpo_zh_demo', pref_id, array_to_string(list_transform(list_filter(conversations, lambda x: x."from" = 'human'), lambda x: coalesce(x.value, '')), chr(10)) FROM toolcall_dpo_zh_demo WHERE conversations IS NOT NULL),
g AS ({_grams("t", "src, id", "chars", 3)}), n AS (SELECT src, id, count(*) AS n FROM g GROUP BY ALL),
b AS (SELECT x.src, x.id AS id_a, y.id AS id_b, count(*) AS shared FROM g x JOIN g y ON x.src = y.src AND x.g = y.g AND x.id < y.id GROUP BY ALL)
SELECT b.src, id_a, id_b FROM b JOIN n p ON p.src = b.src AND p.id = id_a JOIN n q ON q.src = b.src AND q.id = id_b WHERE shared >= 0.6 * (p.n + q.n - shared)"""

P3_SQL = f"""WITH {_RECORDS}, wi AS (SELECT * FROM eval_items WHERE lang <> 'zh'), ci AS (SELECT * FROM eval_items WHERE lang = 'zh'),
rw AS ({_grams("records", "src, rec_id", "words", 10)}), rc AS ({_grams("records", "src, rec_id", "chars", 18)}), iw AS ({_grams("wi", "item_id", "words", 10)}), ic AS ({_grams("ci", "item_id", "chars", 18)})
SELECT src, rec_id, item_id FROM rw JOIN iw USING (g) UNION SELECT src, rec_id, item_id FROM rc JOIN ic USING (g)"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p3_found": P3_SQL}
