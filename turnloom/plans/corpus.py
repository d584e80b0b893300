"""Queries on tables as a whole: splits, samples, rankings, vocabularies, metrics, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import extend as X
from turnloom.operators import projections as J
from turnloom.operators import quality as A
from turnloom.operators import ranking as K
from turnloom.operators import sampling as P
from turnloom.operators import tokens as T
from turnloom.operators import vocabulary as V
from turnloom.operators.rendering import NO_CONTEXT, RAG_PROMPT, numbered_sources, rag_prompt, role_prompt, single_turn
from turnloom.plans.conversations import TURNS, quoted
from turnloom.session import scratch, table
from turnloom.sources import readers as S
from turnloom.sources import writers as W


def _docs(spark, d):
    return table(spark, d, "documents")


def _qa(spark, d):
    return table(spark, d, "qa_sample").dropDuplicates(["qa_id"])


_QA = "(SELECT DISTINCT qa_id, question, answer, dept FROM qa_sample)"
_MD5 = "md5('42:' || doc_id)"


def qa_to_conv(spark, d):
    t = _qa(spark, d).select("qa_id", F.posexplode(J.qa_to_conversation("question", "answer")).alias("turn", "m"))
    return t.select("qa_id", "turn", F.col("m.from").alias("role"), "m.value")


def alpaca_to_conv(spark, d):
    rows = _qa(spark, d).select("qa_id", F.col("question").alias("instruction"), F.col("dept").alias("input"), F.col("answer").alias("output"))
    t = rows.select("qa_id", F.posexplode(J.alpaca_to_conversation()).alias("turn", "m"))
    return t.select("qa_id", "turn", F.col("m.from").alias("role"), "m.value")


def problems_to_conv(spark, d):
    items = table(spark, d, "eval_items").select("item_id", F.col("text").alias("problem"), F.lit("").alias("solution"))
    t = J.problems_to_conversations(items, "eval", "item_id").select("id", F.posexplode("conversations").alias("turn", "m"))
    return t.select("id", "turn", F.col("m.from").alias("role"), "m.value")


def rl_prompt_project(spark, d):
    rows = J.rl_prompt(_qa(spark, d))
    return rows.select("qa_id", "answer", F.get("prompt", 0)["content"].alias("system"), F.get("prompt", 1)["content"].alias("user"))


def rag_answers(spark, d):
    """Prompts with the questions' answers as passages, cut to a context of 200 characters."""
    rows = _qa(spark, d).select("qa_id", rag_prompt(F.array_compact(F.array("answer", "answer")), F.col("question"), 200).alias("prompt"))
    return rows


def sources_numbered(spark, d):
    return _qa(spark, d).select("qa_id", F.array_join(numbered_sources(F.array("question", "dept")), "\n").alias("text"))


def single_turn_prompts(spark, d):
    return _qa(spark, d).select("qa_id", single_turn(F.col("question"), "alpaca").alias("prompt"))


def role_prompts(spark, d):
    pairs = P.drawn_pairs(500, table(spark, d, "eval_items"), table(spark, d, "lang_reference").withColumnRenamed("ref_id", "item_id"), "item_id", "text")
    return pairs.select("id", role_prompt(F.col("left_text"), F.col("right_text")).alias("prompt"))


def pair_char_filter(spark, d):
    rows = table(spark, d, "toolcall_dpo_zh_demo").dropDuplicates(["pref_id"]).withColumn("prompt", F.coalesce("app_id", F.lit("")))
    return P.char_pair_filter(rows, "prompt", "chosen", "rejected", 60).select("pref_id", "chosen", "rejected")


def token_pair_filter(spark, d):
    rows = table(spark, d, "toolcall_dpo_zh_demo").dropDuplicates(["pref_id"]).where("chosen is not null and rejected is not null")
    rows = rows.select("pref_id", T.code_points(F.col("chosen")).alias("a"), T.code_points(F.col("rejected")).alias("b"))
    return P.token_pair_filter(rows, "a", "b", 60).select("pref_id", F.size("a").alias("n_chosen"), F.size("b").alias("n_rejected"))


def nonempty_prompts(spark, d):
    return P.nonempty(_qa(spark, d), "question").select("qa_id", "question")


def split_head_pct(spark, d):
    return P.head_split(_docs(spark, d), "doc_id", 7.35).select("doc_id", "split")


def split_head_floor(spark, d):
    return P.head_split(_docs(spark, d), "doc_id", 7.35, "down").select("doc_id", "split")


def split_hash_holdout(spark, d):
    return P.hash_holdout(_docs(spark, d), "doc_id", 7.35).select("doc_id", "split")


def split_tail_n(spark, d):
    return P.tail_n(_docs(spark, d), 100, "doc_id").select("doc_id", "lang")


def first_rows(spark, d):
    return P.first_n(_docs(spark, d), 120, "doc_id").select("doc_id", "source")


def sample_n(spark, d):
    return P.sample_n(_docs(spark, d), 150, "doc_id").select("doc_id", "source")


def range_select(spark, d):
    return P.range_select(_docs(spark, d), "doc_id", 100, 250).select("doc_id", "n_chars")


def shuffle_places(spark, d):
    s = _docs(spark, d).withColumn("s", F.concat(P.shuffle_key("doc_id"), F.lit(":"), F.col("doc_id").cast("string")))
    return P.ranked(s, "s").select("doc_id", "place")


def batches(spark, d):
    return P.batch_number(_docs(spark, d), "doc_id", 64).select("doc_id", "batch")


def drawn_pairs(spark, d):
    return P.drawn_pairs(500, table(spark, d, "eval_items"), table(spark, d, "lang_reference").withColumnRenamed("ref_id", "item_id"), "item_id", "text")


def shuffled_groups(spark, d):
    return P.shuffled_groups(_qa(spark, d), "qa_id", "question")


def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return K.similar_vectors(q, e.select("vec_id", "embedding"))


def _questions(spark, d):
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text")


def bm25_topk(spark, d):
    return K.bm25(_questions(spark, d), _qa(spark, d).select(F.col("qa_id").alias("doc_id"), F.col("question").alias("text")))


def bm25_pairs_topk(spark, d):
    """The same with pairs of neighbouring Chinese characters as terms."""
    return K.bm25(_questions(spark, d), _qa(spark, d).select(F.col("qa_id").alias("doc_id"), F.col("question").alias("text")), segment=K.words_and_pairs)


def rank_fusion(spark, d):
    """The fusion of the ranking over questions with the one over answers."""
    qa = _qa(spark, d)
    one = K.bm25(_questions(spark, d), qa.select(F.col("qa_id").alias("doc_id"), F.col("question").alias("text")))
    two = K.bm25(_questions(spark, d), qa.select(F.col("qa_id").alias("doc_id"), F.col("answer").alias("text")))
    return K.fused(one, two)


def retrieved_passages(spark, d):
    docs = _qa(spark, d).select(F.col("qa_id").alias("doc_id"), F.col("question").alias("text"))
    r = K.with_passages(_questions(spark, d), K.bm25(_questions(spark, d), docs, k=2), docs, none=NO_CONTEXT)
    return r.select("query_id", F.array_join("passages", "|").alias("passages"), "message")


def word_freq(spark, d):
    return V.word_counts(_docs(spark, d), "text")


def frequent_words(spark, d):
    return V.most_frequent(V.word_counts(_docs(spark, d), "text"), 200)


def vocab_merge(spark, d):
    base = V.read_pieces(table(spark, d, "lang_reference").select(F.col("text").alias("value")))
    more = V.read_pieces(table(spark, d, "eval_items").select(F.col("text").alias("value")))
    counts = V.word_counts(_docs(spark, d), "text")
    return V.merged(base, more, counts, 500)


def jsonl_validate(spark, d):
    """The conversations of every record as a line of JSON, each checked as it is."""
    t = table(spark, d, "toolcall_dpo_zh_demo").dropDuplicates(["pref_id"])
    return A.validated(t.select("pref_id", F.to_json(F.struct("conversations")).alias("value"))).select("pref_id", "error")


def validation_counts(spark, d):
    return A.validation_report(jsonl_validate(spark, d))


def mse_mae(spark, d):
    return A.squared_and_absolute_error(table(spark, d, "lineitem"), "l_discount", "l_tax").select(F.round("mse", 8).alias("mse"), F.round("mae", 8).alias("mae"))


def pairwise_logloss(spark, d):
    loss = A.pairwise_log_loss(F.col("l_discount") * 100, F.col("l_tax") * 100)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(loss), 6).alias("loss"))


def token_accuracy(spark, d):
    """Characters of a text as predictions of the next ones."""
    rows = _docs(spark, d).where("text is not null").select(T.code_points(F.col("text")).alias("ids"))
    return T.next_token_accuracy(rows, "ids", "ids").select(F.round("accuracy", 9).alias("accuracy"))


def corpus_perplexity(spark, d):
    rows = _qa(spark, d).where("answer is not null").withColumn("nll", F.length("answer") * 0.5 * F.lit(1000.0))
    return A.corpus_perplexity(rows, "nll", "answer").select(F.round("perplexity", 9).alias("perplexity"))


def argmax_dims(spark, d):
    return table(spark, d, "embeddings").select("vec_id", T.argmax(F.col("embedding")).alias("dim"))


def token_usage(spark, d):
    rows = _qa(spark, d).select("qa_id", F.coalesce(F.length("question"), F.lit(0)).alias("p"), F.coalesce(F.length("answer"), F.lit(0)).alias("c"))
    return A.token_usage(rows, "p", "c").select("qa_id", "total_tokens")


def device_counts(spark, d):
    return A.count_and_size(_docs(spark, d), "source", "n_chars")


def trainable_share(spark, d):
    rows = table(spark, d, "part").select(F.col("p_size").alias("n"), (F.col("p_partkey") % 3 == 0).alias("on"))
    return A.trainable_share(rows, "n", "on").select("trainable", "total", F.round("percent", 6).alias("percent"))


def reward_functions(spark, d):
    """Two rewards of the user's own beside each other."""
    rows = _qa(spark, d).select("qa_id", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("question", F.lit("")).alias("question"))
    out = X.reward_columns(rows, {"size": lambda a, q: a.str.len(), "same": lambda a, q: (a == q).astype(float)}, ["answer", "question"])
    return out.select("qa_id", "size", "same")


def batch_function(spark, d):
    """A function of batches that gives two rows for each."""
    import pandas as pd

    twice = lambda b: pd.concat([b.assign(half=0), b.assign(half=1)])
    return X.batched(_docs(spark, d).select("doc_id"), twice, "doc_id bigint, half int")


def scored_rows(spark, d):
    return X.scored(_docs(spark, d).where("text is not null").select("doc_id", "text"), lambda: lambda s: s.str.count("a"), "text").select("doc_id", "score")


def generated_texts(spark, d):
    """A stand-in for a service: the prompt turned round."""
    out = X.generated(_qa(spark, d).select("qa_id", "question"), lambda p: [None if x is None else x[::-1] for x in p], "question")
    return out.select("qa_id", "response")


def group_metrics(spark, d):
    return X.grouped_metric(table(spark, d, "part"), "p_size", lambda p: p.max() - p.min(), ["p_retailprice"]).select("p_size", F.round("metric", 6).alias("metric"))


def shards(spark, d):
    return P.sharded(_docs(spark, d).select("doc_id"), 4, "doc_id").groupBy("doc_id").agg(F.count("*").alias("times"))


def zipped_lists(spark, d):
    """Words of question and answer side by side, up to the end of the shorter."""
    rows = _qa(spark, d).where("question is not null and answer is not null")
    z = J.zipped(F.split("question", "，"), F.split("answer", "，"))
    return rows.select("qa_id", F.posexplode(z).alias("pos", "x")).select("qa_id", "pos", "x.a", "x.b")


def jsonl_round_trip(spark, d):
    """Preferences with and without tools in files of their own, read again by name."""
    t = table(spark, d, "toolcall_dpo_zh_demo").dropDuplicates(["pref_id"])
    base = scratch(spark, "jsonl")
    W.write_jsonl(t.where("tools is null").select("pref_id", "chosen"), f"{base}/a", nulls=True)
    tools, odd = t.where("tools is not null").select("pref_id", "chosen", "tools"), F.col("pref_id") % 2 == 1
    W.write_jsonl(tools.where(odd), f"{base}/b", nulls=True)
    W.write_jsonl(tools.where(~odd), f"{base}/b", nulls=True, append=True)
    return S.read_aligned(spark, [f"{base}/a", f"{base}/b"]).select("pref_id", "chosen", "tools")


def csv_round_trip(spark, d):
    base = scratch(spark, "tsv")
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("-")), r"[\t\r\n\"\\\\]", " ")
    rows = _qa(spark, d).select(F.col("qa_id").cast("string").alias("a"), flat(F.col("dept")).alias("b"))
    rows.write.option("sep", "\t").csv(base)
    return S.read_tsv(spark, base, ["input", "output"])


def text_round_trip(spark, d):
    base = scratch(spark, "txt")
    one = table(spark, d, "en_article_tail500").dropDuplicates(["line_id"]).select(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]", " ").alias("value"))
    one.write.text(base)
    return S.read_text(spark, base, linebreaks=True).groupBy("text").agg(F.count("*").alias("n"))


def streamed_roles(spark, d):
    """Roles of the conversations, counted over a stream of files that is read to its end."""
    from turnloom.streaming import each_batch, stream_jsonl

    base = scratch(spark, "stream")
    W.write_jsonl(table(spark, d, "toolcall_dpo_zh_demo").dropDuplicates(["pref_id"]).select("pref_id", "conversations"), f"{base}/in")
    stream = stream_jsonl(spark, f"{base}/in", "pref_id bigint, conversations array<struct<`from`:string,value:string>>")

    def work(b):
        return b.select(F.explode("conversations").alias("m")).groupBy(F.col("m.from").alias("role")).agg(F.count("*").alias("n"))

    each_batch(stream, work, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("role").agg(F.sum("n").alias("n"))


_BM25 = """
{c}_w AS (SELECT {id} AS doc_id, list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {rows} WHERE {t} IS NOT NULL),
{c}_tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM {c}_w) GROUP BY ALL),
{c}_st AS (SELECT count(*) AS n, avg(len(w)) AS av FROM {c}_w), {c}_df AS (SELECT term, count(*) AS df FROM {c}_tf GROUP BY term),
{c}_q AS (SELECT query_id, unnest(list_distinct(w)) AS term FROM (SELECT item_id AS query_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM eval_items)),
{c}_s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / av))), 6) AS score FROM {c}_q JOIN {c}_df USING (term) JOIN {c}_tf USING (term), {c}_st GROUP BY ALL),
{c} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS nth FROM {c}_s) WHERE nth <= {k})"""
_ONE = _BM25.format(c="one", id="qa_id", t="question", rows=_QA, k=5)
_TWO = _BM25.format(c="two", id="qa_id", t="answer", rows=_QA, k=5)
_WORDS_OF = "list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_PAIRS_OF = "flatten(list_transform(list_filter(regexp_split_to_array(lower(regexp_replace({t}, '(\\p{{Han}}+)', ' \\1 ', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), lambda r: CASE WHEN regexp_full_match(r, '\\p{{Han}}{{2,}}') THEN list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) ELSE [r] END))"
_PAIRED = _BM25.replace(_WORDS_OF.replace("{t}", "text"), _PAIRS_OF.replace("{t}", "text")).replace(_WORDS_OF, _PAIRS_OF).format(c="one", id="qa_id", t="question", rows=_QA, k=5)
_CONV = "SELECT {id}, CAST(t AS INTEGER) AS turn, CASE WHEN t = 0 THEN 'human' ELSE 'gpt' END AS role, CASE WHEN t = 0 THEN {a} ELSE {b} END AS value FROM {rows}, (VALUES (0), (1)) v(t)"
_WORDS = r"(SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS word FROM documents) WHERE word <> '' GROUP BY word)"
_DRAWN = """a AS (SELECT text AS left_text, row_number() OVER (ORDER BY item_id) - 1 AS l FROM eval_items), b AS (SELECT text AS right_text, row_number() OVER (ORDER BY ref_id) - 1 AS r FROM lang_reference), i AS (SELECT unnest(range(500)) AS id),
p AS (SELECT i.id, left_text, right_text FROM i JOIN a ON l = CAST('0x' || substr(md5('42:l:' || i.id), 1, 12) AS BIGINT) % (SELECT count(*) FROM a) JOIN b ON r = CAST('0x' || substr(md5('42:r:' || i.id), 1, 12) AS BIGINT) % (SELECT count(*) FROM b))"""
_K, _Q = "{context_str}", "{query_str}"
_RAG = quoted(RAG_PROMPT).replace(_K, "' || left(answer || chr(10) || answer, " + str(max(200 - len(RAG_PROMPT), 0)) + ") || '").replace(_Q, "' || question || '")

QUERIES = {
    "qa_to_conv": (qa_to_conv, _CONV.format(id="qa_id", a="question", b="answer", rows=_QA)),
    "alpaca_to_conv": (alpaca_to_conv, _CONV.format(id="qa_id", a="CASE WHEN length(coalesce(trim(dept), '')) > 0 THEN question || chr(10) || chr(10) || dept ELSE question END", b="answer", rows=_QA)),
    "problems_to_conv": (problems_to_conv, _CONV.format(id="id", a=f"text || ' ' || {quoted(J.STEP_BY_STEP)}", b=f"'{J.NO_SOLUTION}'", rows="(SELECT 'eval-' || (row_number() OVER (ORDER BY item_id) - 1) AS id, text FROM eval_items)")),
    "rl_prompt_project": (rl_prompt_project, f"SELECT qa_id, answer, {quoted(J.REASONING_PROMPT)} AS system, question AS \"user\" FROM {_QA}"),
    "rag_answers": (rag_answers, f"SELECT qa_id, CASE WHEN answer IS NOT NULL THEN {_RAG} END AS prompt FROM {_QA}"),
    "sources_numbered": (sources_numbered, f"SELECT qa_id, concat_ws(chr(10), '[1]' || chr(9) || ' \"' || question || '\"', '[2]' || chr(9) || ' \"' || dept || '\"') AS text FROM {_QA}"),
    "single_turn_prompts": (single_turn_prompts, f"SELECT qa_id, 'Below is an instruction that describes a task. Write a response that appropriately completes the request.' || chr(10) || chr(10) || '### Instruction:' || chr(10) || question || chr(10) || chr(10) || '### Response:' || chr(10) AS prompt FROM {_QA}"),
    "role_prompts": (role_prompts, f"WITH {_DRAWN} SELECT id, '你是护士，跟患者对话。' || chr(10) || chr(10) || '护士角色：' || left_text || chr(10) || '患者角色：' || right_text AS prompt FROM p"),
    "pair_char_filter": (pair_char_filter, f"WITH {TURNS}, x AS (SELECT DISTINCT pref_id, coalesce(app_id, '') AS p, chosen, rejected FROM toolcall_dpo_zh_demo) SELECT pref_id, chosen, rejected FROM x WHERE length(p || chosen) BETWEEN 1 AND 60 AND length(p || rejected) BETWEEN 1 AND 60"),
    "token_pair_filter": (token_pair_filter, f"WITH {TURNS} SELECT pref_id, CAST(length(chosen) AS INTEGER) AS n_chosen, CAST(length(rejected) AS INTEGER) AS n_rejected FROM c WHERE length(chosen) BETWEEN 1 AND 60 AND length(rejected) BETWEEN 1 AND 60"),
    "nonempty_prompts": (nonempty_prompts, f"SELECT qa_id, question FROM {_QA} WHERE length(question) > 0"),
    "split_head_pct": (split_head_pct, "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor((SELECT count(*) FROM documents) * 7.35 / 100 + 0.5) THEN 'validation' ELSE 'train' END AS split FROM documents"),
    "split_head_floor": (split_head_floor, "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor((SELECT count(*) FROM documents) * 7.35 / 100) THEN 'validation' ELSE 'train' END AS split FROM documents"),
    "split_hash_holdout": (split_hash_holdout, f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_MD5}, doc_id) <= ceil((SELECT count(*) FROM documents) * 7.35 / 100) THEN 'validation' ELSE 'train' END AS split FROM documents"),
    "split_tail_n": (split_tail_n, "SELECT doc_id, lang FROM documents ORDER BY doc_id DESC LIMIT 100"),
    "first_rows": (first_rows, "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 120"),
    "sample_n": (sample_n, f"SELECT doc_id, source FROM documents ORDER BY {_MD5}, doc_id LIMIT 150"),
    "range_select": (range_select, "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 150 OFFSET 100"),
    "shuffle_places": (shuffle_places, f"SELECT doc_id, row_number() OVER (ORDER BY {_MD5}, doc_id) - 1 AS place FROM documents"),
    "batches": (batches, "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 64 AS BIGINT) AS batch FROM documents"),
    "drawn_pairs": (drawn_pairs, f"WITH {_DRAWN} SELECT * FROM p"),
    "shuffled_groups": (shuffled_groups, f"WITH o AS (SELECT question, row_number() OVER (ORDER BY md5('42:' || qa_id), CAST(qa_id AS VARCHAR)) - 1 AS place FROM {_QA}), g AS (SELECT place // 5 AS grp, place % 5 + 1 AS n, question FROM o) SELECT CAST(grp AS BIGINT) AS grp, string_agg(n || '. ' || question, chr(10) ORDER BY n) AS texts FROM g GROUP BY grp HAVING max(n) FILTER (question IS NOT NULL) = 5"),
    "cosine_topk": (
        cosine_topk,
        "WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, round(list_sum(list_transform(range(1, len(q) + 1), lambda i: CAST(q[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE))) / (sqrt(list_sum(list_transform(q, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS score FROM q, embeddings) SELECT query_id, vec_id, score, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS nth FROM s) WHERE nth <= 5",
    ),
    "bm25_pairs_topk": (bm25_pairs_topk, f"WITH {_PAIRED} SELECT * FROM one"),
    "bm25_topk": (bm25_topk, f"WITH {_ONE} SELECT * FROM one"),
    "rank_fusion": (rank_fusion, f"WITH {_ONE}, {_TWO}, b AS (SELECT query_id, doc_id, 0.5 / (2.0 + nth) AS s FROM one UNION ALL SELECT query_id, doc_id, 0.5 / (2.0 + nth) FROM two), f AS (SELECT query_id, doc_id, round(sum(CAST(s AS DOUBLE)), 6) AS score FROM b GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS nth FROM f) WHERE nth <= 5"),
    "retrieved_passages": (retrieved_passages, f"WITH {_BM25.format(c='one', id='qa_id', t='question', rows=_QA, k=2)}, p AS (SELECT query_id, string_agg(question, '|' ORDER BY nth) AS passages FROM one JOIN {_QA} ON qa_id = doc_id GROUP BY query_id) SELECT item_id AS query_id, coalesce(passages, '') AS passages, CASE WHEN passages IS NULL THEN '{NO_CONTEXT}' END AS message FROM eval_items LEFT JOIN p ON query_id = item_id"),
    "word_freq": (word_freq, f"SELECT word, freq FROM {_WORDS}"),
    "frequent_words": (frequent_words, f"SELECT word, freq FROM {_WORDS} ORDER BY freq DESC, word LIMIT 200"),
    "vocab_merge": (
        vocab_merge,
        rf"WITH one AS (SELECT DISTINCT regexp_extract(text, '[^\s\p{{Z}}]+') AS piece FROM lang_reference), two AS (SELECT DISTINCT regexp_extract(text, '[^\s\p{{Z}}]+') AS piece FROM eval_items), top AS (SELECT word AS piece FROM (SELECT * FROM {_WORDS} ORDER BY freq DESC, word LIMIT 500) WHERE regexp_full_match(word, '[一-龥]*')), u AS (SELECT piece, 'base' AS source FROM one WHERE piece <> '' UNION ALL SELECT piece, 'domain' FROM two WHERE piece <> '' AND piece NOT IN (SELECT piece FROM one)) SELECT piece, source, 0.0::DOUBLE AS score FROM u UNION ALL SELECT piece, 'words', 0.0::DOUBLE FROM top WHERE piece NOT IN (SELECT piece FROM u)",
    ),
    "jsonl_validate": (jsonl_validate, f"WITH {TURNS} SELECT pref_id, CASE WHEN conversations IS NULL THEN 'no conversations' WHEN len(list_filter(conversations, lambda x: x.\"from\" IS NULL OR x.value IS NULL)) > 0 THEN 'item without from or value' WHEN len(list_filter(conversations, lambda x: x.\"from\" NOT IN ('system', 'human', 'gpt'))) > 0 THEN 'unknown role' END AS error FROM c"),
    "validation_counts": (validation_counts, f"WITH {TURNS}, v AS (SELECT pref_id, CASE WHEN conversations IS NULL THEN 'no conversations' WHEN len(list_filter(conversations, lambda x: x.\"from\" IS NULL OR x.value IS NULL)) > 0 THEN 'item without from or value' WHEN len(list_filter(conversations, lambda x: x.\"from\" NOT IN ('system', 'human', 'gpt'))) > 0 THEN 'unknown role' END AS error FROM c) SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS valid, count(*) FILTER (error IS NOT NULL) AS invalid FROM v"),
    "mse_mae": (mse_mae, "SELECT round(avg((l_discount - l_tax) ** 2), 8) AS mse, round(avg(abs(l_discount - l_tax)), 8) AS mae FROM lineitem"),
    "pairwise_logloss": (pairwise_logloss, "SELECT l_returnflag, round(avg(-ln(1 / (1 + exp(-(l_discount - l_tax) * 100)))), 6) AS loss FROM lineitem GROUP BY l_returnflag"),
    "token_accuracy": (token_accuracy, "WITH x AS (SELECT text, unnest(range(1, length(text))) AS i FROM documents WHERE text IS NOT NULL) SELECT round(avg(CAST(substr(text, i, 1) = substr(text, i + 1, 1) AS INT)), 9) AS accuracy FROM x"),
    "corpus_perplexity": (corpus_perplexity, f"SELECT round(exp(sum(length(answer) * 0.5 * 1000.0) / (count(*) * sum(length(answer)))), 9) AS perplexity FROM {_QA} WHERE answer IS NOT NULL"),
    "argmax_dims": (argmax_dims, "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS dim FROM embeddings"),
    "token_usage": (token_usage, f"SELECT qa_id, CAST(coalesce(length(question), 0) + coalesce(length(answer), 0) AS INTEGER) AS total_tokens FROM {_QA}"),
    "device_counts": (device_counts, "SELECT source, count(*) AS count, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY source"),
    "trainable_share": (trainable_share, "SELECT CAST(sum(p_size) FILTER (p_partkey % 3 = 0) AS BIGINT) AS trainable, CAST(sum(p_size) AS BIGINT) AS total, round(100 * sum(p_size) FILTER (p_partkey % 3 = 0) / sum(p_size), 6) AS percent FROM part"),
    "reward_functions": (reward_functions, f"SELECT qa_id, CAST(length(coalesce(answer, '')) AS DOUBLE) AS size, CASE WHEN coalesce(answer, '') = coalesce(question, '') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS same FROM {_QA}"),
    "batch_function": (batch_function, "SELECT doc_id, CAST(h AS INTEGER) AS half FROM documents, (VALUES (0), (1)) v(h)"),
    "scored_rows": (scored_rows, "SELECT doc_id, CAST(length(text) - length(replace(text, 'a', '')) AS DOUBLE) AS score FROM documents WHERE text IS NOT NULL"),
    "generated_texts": (generated_texts, f"SELECT qa_id, list_aggregate(list_reverse(string_split(question, '')), 'string_agg', '') AS response FROM {_QA}"),
    "group_metrics": (group_metrics, "SELECT p_size, round(max(p_retailprice) - min(p_retailprice), 6) AS metric FROM part GROUP BY p_size"),
    "shards": (shards, "SELECT doc_id, count(*) AS times FROM documents GROUP BY doc_id"),
    "zipped_lists": (zipped_lists, f"WITH s AS (SELECT qa_id, string_split(question, '，') AS a, string_split(answer, '，') AS b FROM {_QA} WHERE question IS NOT NULL AND answer IS NOT NULL) SELECT qa_id, CAST(i - 1 AS INTEGER) AS pos, a[i] AS a, b[i] AS b FROM (SELECT *, unnest(range(1, least(len(a), len(b)) + 1)) AS i FROM s)"),
    "jsonl_round_trip": (jsonl_round_trip, f"WITH {TURNS} SELECT pref_id, chosen, tools FROM c"),
    "csv_round_trip": (csv_round_trip, f"SELECT CAST(qa_id AS VARCHAR) AS input, coalesce(dept, '-') AS output FROM {_QA}"),
    "text_round_trip": (text_round_trip, "SELECT coalesce(text, '') || chr(10) AS text, count(*) AS n FROM (SELECT DISTINCT line_id, text FROM en_article_tail500) GROUP BY 1"),
    "streamed_roles": (streamed_roles, f"WITH {TURNS} SELECT role, count(*) AS n FROM turns GROUP BY role"),
}
