"""Queries on texts and token lists: name to (query, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.operators import chunks as CH
from turnloom.operators import tokens as T
from turnloom.operators.conversations import normalized_roles, paired, to_turns
from turnloom.plans.conversations import TURNS
from turnloom.session import table

#: Python's white space, in the pattern language of the SQL.
WS = r"[\s\p{Z}\x1c-\x1f\x0b\x{85}]"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _answers(spark, d):
    return table(spark, d, "qa_sample").dropDuplicates(["qa_id"])


def _docs(spark, d):
    return table(spark, d, "documents")


_QA = "(SELECT DISTINCT qa_id, question, answer, dept FROM qa_sample)"


def text_normalize(spark, d):
    return _docs(spark, d).select("doc_id", X.normalized("text").alias("text"))


def text_strip(spark, d):
    return _docs(spark, d).select("doc_id", X.strip("text").alias("text"))


def text_tidy(spark, d):
    return _docs(spark, d).select("doc_id", X.tidy_reply("text").alias("text"))


def extract_answer(spark, d):
    return _docs(spark, d).select("doc_id", X.extracted_answer("text").alias("answer"))


def format_reward(spark, d):
    """Answers written as thoughts and an answer on one line, every third one with a line feed in the thoughts."""
    broken = F.when(F.col("qa_id") % 3 == 0, "\n").otherwise("")
    return _answers(spark, d).select("qa_id", X.format_reward(F.concat(F.lit("<think>a"), broken, F.lit("b</think><answer>"), F.coalesce(F.regexp_replace("answer", r"\s", " "), F.lit("")), F.lit("</answer>"))).alias("reward"))


def accuracy_reward(spark, d):
    reply = F.concat(F.lit("<answer> "), F.upper("dept"), F.lit(" </answer>"))
    return _answers(spark, d).select("qa_id", X.accuracy_reward(reply, F.concat(F.lit("because #### "), "dept")).alias("reward"))


def boxed_answer(spark, d):
    """A box with the answer in it, behind another one; a box of the other kind stands last, and alone for some keys."""
    inside = F.concat(F.regexp_replace("answer", r"[{}\\]", ""), F.lit("{n}"))
    both = F.concat(F.lit("\\boxed{0} and \\boxed{"), inside, F.lit("} or \\fbox{2} end"))
    t = F.when(F.col("qa_id") % 3 == 0, F.concat(F.lit("\\fbox{0} then \\fbox{"), inside, F.lit("}."))).otherwise(both)
    return _answers(spark, d).select("qa_id", X.boxed(t).alias("box"), X.boxed_solution(t).alias("inside"))


def chinese_flags(spark, d):
    return _docs(spark, d).select("doc_id", X.all_chinese("text").alias("all_zh"), X.has_chinese("text").alias("has_zh"))


def stop_cut(spark, d):
    return _docs(spark, d).select("doc_id", X.cut_at_stop("text", "。").alias("one"), X.cut_at_stops("text", ["observation", ". ", "，"]).alias("many"))


def stop_words(spark, d):
    """Stop words of every department: with a line feed, without, and the name itself."""
    s = F.array(F.concat(F.lit("\n"), "dept"), F.lit("\n\n"), F.col("dept"))
    rows = _answers(spark, d).where("dept is not null").select("dept").distinct()
    return rows.select("dept", F.array_join(X.expanded_stops(s), "|").alias("stops"))


def numbered_items(spark, d):
    items = X.numbered_items(F.regexp_replace("answer", "\n", "\n\n"))
    return _answers(spark, d).where("answer is not null").select("qa_id", F.posexplode(items).alias("pos", "item"))


def text_md5(spark, d):
    return _docs(spark, d).select("doc_id", X.head_md5(F.encode("text", "UTF-8")).alias("hash"))


def sentence_chunks(spark, d):
    chunks = CH.sentence_chunks(F.col("text"), 250)
    return _docs(spark, d).where("text is not null").select("doc_id", F.posexplode(chunks).alias("chunk_no", "chunk"))


def sentence_chunks_overlap(spark, d):
    rows = _docs(spark, d).where("text is not null").select("doc_id", CH.sentence_chunks(F.col("text"), 250).alias("c"))
    return rows.select("doc_id", F.posexplode(CH.overlapped(F.col("c"), 50)).alias("chunk_no", "chunk"))


def document_chunks(spark, d):
    return CH.document_chunks(_docs(spark, d), "doc_id", "text")


def bos_ids(spark, d):
    """Ids with one at their beginning, as for the first segment of a text."""
    ids = T.tokenized(F.col("text"), bos=1)
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(ids).alias("n"), F.get(ids, 0).alias("first"))


def block_labels(spark, d):
    """Packed blocks with their mask and labels."""
    docs = _docs(spark, d).select("doc_id", T.code_points(F.coalesce("text", F.lit(""))).alias("ids"))
    b = T.block_rows(T.packed_blocks(docs, "doc_id", "ids", 512, 2))
    add = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return b.select("g", "block", add(F.col("attention_mask")).alias("real"), add(F.col("labels")).alias("total"))


def loss_perplexity(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(X.perplexity(F.col("l_discount") * 20), 6).alias("perplexity"))


def length_factor(spark, d):
    return _docs(spark, d).select("doc_id", X.rope_factor("n_chars", 512).alias("factor"))


def merged_lines(spark, d):
    lines = table(spark, d, "en_article_tail500").where("text is not null").select("art_id", "line_id", "text").dropDuplicates(["line_id"])
    return CH.merged_lines(lines, "art_id", "line_id", "text")


def markdown_lines(spark, d):
    from turnloom.sources.readers import markdown_text

    return markdown_text(_docs(spark, d), "doc_id", "text")


def token_ids(spark, d):
    ids = T.code_points(F.col("text"))
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(ids).alias("n"), F.aggregate(ids, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


def padded_blocks(spark, d):
    ids = T.code_points(F.col("text"))
    block, mask = T.padded(ids, 256), T.padding_mask(ids, 256)
    add = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(block).alias("n"), add(block).alias("total"), add(mask).alias("real"), F.size(T.padded_to_multiple(ids, 4)).alias("multiple"))


def _packed(spark, d, per=None):
    docs = _docs(spark, d).select("doc_id", T.code_points(F.coalesce("text", F.lit(""))).alias("ids"))
    b = T.packed_blocks(docs, "doc_id", "ids", 512, 2, per)
    return b.select("g", "block", F.size("input_ids").alias("n"), "n_docs", F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


def pack_blocks(spark, d):
    return _packed(spark, d)


def pack_blocks_grouped(spark, d):
    """Packing within groups of neighbouring keys, whose rests are lost one by one."""
    return _packed(spark, d, F.floor(F.col("doc_id") / 1000).cast("bigint"))


def _encoded(spark, d):
    turns = to_turns(table(spark, d, "toolcall_dpo_zh_demo"), "pref_id")
    return T.supervised_lengths(paired(normalized_roles(turns)), 200)


def sft_encode(spark, d):
    return _encoded(spark, d).select("conv_id", "pair", F.size("src").alias("n_src"), F.size("tgt").alias("n_tgt"))


def sft_masks(spark, d):
    from turnloom.operators.sampling import some_label

    rows = some_label(T.supervised_rows(_encoded(spark, d)))
    return rows.select("conv_id", F.size("input_ids").alias("n"), F.size(F.filter("labels", lambda x: x == T.IGNORED)).alias("masked"), F.size("attention_mask").alias("mask"))


def context_cut(spark, d):
    ids = X.keep_last(T.code_points(F.col("text")), 300, 100)
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(ids).alias("n"), F.try_element_at(ids, F.lit(1)).alias("first"))


def prompt_lengths(spark, d):
    from turnloom.operators.sampling import prompt_length_filter

    rows = _answers(spark, d).select("qa_id", F.col("question").alias("prompt"), F.array("question", "answer").alias("m"), F.size(T.code_points(F.col("question"))).alias("n"))
    return prompt_length_filter(rows, "m", "prompt", "n", 100).select("qa_id", "n")


_SENTENCES = r"""s AS (SELECT doc_id, string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])""" + WS + r"""+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, list_reduce(list_prepend(struct_pack(o := CAST([] AS VARCHAR[]), c := ''), list_transform(p, lambda x: struct_pack(o := CAST([] AS VARCHAR[]), c := x))),
  lambda a, x: CASE WHEN length(a.c) + length(x.c) <= 250 OR a.c = '' THEN struct_pack(o := a.o, c := a.c || CASE WHEN a.c = '' THEN '' ELSE ' ' END || x.c) ELSE struct_pack(o := list_append(a.o, a.c), c := x.c) END) AS z FROM s),
k AS (SELECT doc_id, CASE WHEN z.c = '' THEN z.o ELSE list_append(z.o, z.c) END AS chunks FROM f)"""
_WIDE_CHUNKS = f"""WITH RECURSIVE {_SENTENCES}, zh AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, '[一-鿿]')),
w AS (SELECT doc_id, text, 0 AS i, 1 AS a, 1 AS b FROM zh WHERE text <> '' UNION ALL
  SELECT doc_id, text, i + 1, b, CASE WHEN regexp_matches(substr(text, b + 200, 50), '[。！？\\n]') THEN b + 200 + length(regexp_extract(substr(text, b + 200, 50), '(?s)^[^。！？\\n]*[。！？\\n]')) ELSE b + 250 END FROM w WHERE b <= length(text)),
q AS (SELECT doc_id, list(substr(text, a, b - a) ORDER BY i) AS chunks FROM w WHERE i > 0 GROUP BY doc_id),
every AS (SELECT doc_id, chunks FROM q UNION ALL SELECT doc_id, chunks FROM k WHERE doc_id NOT IN (SELECT doc_id FROM zh))
SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_no, CASE WHEN i < len(chunks) THEN {_stripped("chunks[i] || ' ' || left(chunks[i + 1], 50)")} ELSE chunks[i] END AS chunk FROM (SELECT *, unnest(range(1, len(chunks) + 1)) AS i FROM every)"""
_MARKDOWN = rf"""WITH a AS (SELECT doc_id, regexp_replace(text, '(?m)^\s{{0,3}}(?:#{{1,6}}\s+|>\s?|[-*+]\s+|\d+\.\s+|```.*$|[-*_]{{3,}}\s*$)', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\*\*|__|`', '', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?i)<(?:br|/p|/div|/li|/tr|/h[1-6]|/title)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') AS t FROM b),
d AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM c),
l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\r\n|[\n\x0b\f\r\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {_stripped('x')}), lambda x: x <> '') AS l FROM d)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)"""
_UNITS = "x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT doc_id, t, CAST(length(t) + CASE WHEN ends_with(t, chr(2)) THEN 0 ELSE 1 END AS BIGINT) AS n, {g} AS g FROM x)"
_PACK = (
    "WITH "
    + _UNITS
    + """, o AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n AS s, sum(n) OVER (PARTITION BY g) AS total FROM n),
e AS (SELECT g, doc_id, total, (s + i - 1) // 512 AS block, CASE WHEN i <= length(t) THEN CAST(unicode(substr(t, i, 1)) AS BIGINT) ELSE 2 END AS id FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM o))
SELECT g, CAST(block AS BIGINT) AS block, CAST(count(*) AS INTEGER) AS n, count(DISTINCT doc_id) AS n_docs, CAST(sum(id) AS BIGINT) AS total FROM e WHERE total < 512 OR (block + 1) * 512 <= total GROUP BY g, block"""
)
_SFT = f"""{TURNS}, l AS (SELECT conv_id, pair, length(question) AS a, length(answer) AS b FROM pairs),
sh AS (SELECT conv_id, pair, CAST(least(a, CASE WHEN a + b = 0 THEN 0 ELSE 200 * a // (a + b) END) AS BIGINT) AS n_src, CAST(CASE WHEN b > CASE WHEN a + b = 0 THEN 0 ELSE 200 * b // (a + b) END THEN greatest(200 * b // (a + b) - 1, 0) ELSE b END AS BIGINT) AS n_tgt FROM l),
enc AS (SELECT * FROM (SELECT *, sum(n_src + n_tgt + 1) OVER (PARTITION BY conv_id ORDER BY pair ROWS UNBOUNDED PRECEDING) AS c FROM sh) WHERE c <= 200)"""

QUERIES = {
    "text_normalize": (text_normalize, f"SELECT doc_id, regexp_replace(lower({_stripped('coalesce(text, chr(32))')}), '{WS}+', ' ', 'g') AS text FROM documents"),
    "text_strip": (text_strip, f"SELECT doc_id, {_stripped('text')} AS text FROM documents"),
    "text_tidy": (text_tidy, f"SELECT doc_id, regexp_replace(regexp_replace(text, '^\\n+', ''), '{WS}+$', '') AS text FROM documents"),
    "extract_answer": (extract_answer, f"SELECT doc_id, {_stripped('''CASE WHEN regexp_matches(t, '(?s)<answer>(.*?)</answer>') THEN regexp_extract(t, '(?s)<answer>(.*?)</answer>', 1) ELSE t END''')} AS answer FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"),
    "format_reward": (format_reward, f"SELECT qa_id, CASE WHEN qa_id % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS reward FROM {_QA}"),
    "accuracy_reward": (accuracy_reward, f"SELECT qa_id, CASE WHEN dept IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS reward FROM {_QA}"),
    "boxed_answer": (boxed_answer, f"SELECT qa_id, CASE WHEN qa_id % 3 = 0 THEN '\\fbox{{' ELSE '\\boxed{{' END || b || '}}' AS box, CASE WHEN qa_id % 3 <> 0 THEN b END AS inside FROM (SELECT qa_id, regexp_replace(answer, '[{{}}\\\\]', '', 'g') || '{{n}}' AS b FROM {_QA})"),
    "chinese_flags": (chinese_flags, "SELECT doc_id, regexp_full_match(text, '[一-龥]*') AS all_zh, regexp_matches(text, '[一-鿿]') AS has_zh FROM documents"),
    "stop_cut": (stop_cut, "SELECT doc_id, split_part(text, '。', 1) AS one, split_part(split_part(split_part(text, 'observation', 1), '. ', 1), '，', 1) AS many FROM documents"),
    "stop_words": (stop_words, f"SELECT DISTINCT dept, chr(10) || dept || '|' || chr(10) || chr(10) || '|' || dept AS stops FROM {_QA} WHERE dept IS NOT NULL"),
    "numbered_items": (
        numbered_items,
        f"""WITH p AS (SELECT qa_id, list_filter(list_transform(string_split(replace(answer, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: {_stripped('x')}), lambda x: x <> '') AS l FROM {_QA} WHERE answer IS NOT NULL),
q AS (SELECT qa_id, list_filter(list_transform(l, lambda x: {_stripped('''CASE WHEN contains(x, '.') THEN substr(x, strpos(x, '.') + 1) ELSE x END''')}), lambda x: x <> '') AS l FROM p)
SELECT qa_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS item FROM (SELECT qa_id, l, unnest(range(1, len(l) + 1)) AS i FROM q)""",
    ),
    "text_md5": (text_md5, "SELECT doc_id, md5(array_slice(encode(text), 1, 1048576)) AS hash FROM documents"),
    "sentence_chunks": (sentence_chunks, f"WITH {_SENTENCES} SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_no, chunks[i] AS chunk FROM (SELECT *, unnest(range(1, len(chunks) + 1)) AS i FROM k)"),
    "sentence_chunks_overlap": (sentence_chunks_overlap, f"WITH {_SENTENCES} SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_no, CASE WHEN i < len(chunks) THEN {_stripped('''chunks[i] || ' ' || left(chunks[i + 1], 50)''')} ELSE chunks[i] END AS chunk FROM (SELECT *, unnest(range(1, len(chunks) + 1)) AS i FROM k)"),
    "document_chunks": (document_chunks, _WIDE_CHUNKS),
    "bos_ids": (bos_ids, "SELECT doc_id, CAST(length(text) + 1 AS INTEGER) AS n, 1 AS first FROM documents WHERE text IS NOT NULL"),
    "block_labels": (block_labels, "SELECT g, block, CAST(n AS BIGINT) AS real, total FROM (" + _PACK.format(g="CAST(0 AS BIGINT)") + ")"),
    "loss_perplexity": (loss_perplexity, "SELECT l_orderkey, l_linenumber, round(exp(l_discount * 20), 6) AS perplexity FROM lineitem"),
    "length_factor": (length_factor, "SELECT doc_id, CAST(ceil(n_chars / 512) AS DOUBLE) AS factor FROM documents"),
    "merged_lines": (
        merged_lines,
        f"""WITH l AS (SELECT DISTINCT art_id, line_id, {_stripped('text')} AS t FROM en_article_tail500 WHERE text IS NOT NULL), e AS (SELECT * FROM l WHERE t <> ''),
g AS (SELECT *, coalesce(sum(CAST(strpos('{CH.LINE_ENDS.replace("'", "''")}', right(t, 1)) > 0 AS INT)) OVER (PARTITION BY art_id ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM e)
SELECT art_id, CAST(part AS BIGINT) AS part, string_agg(t, '' ORDER BY line_id) AS text FROM g GROUP BY art_id, part""",
    ),
    "markdown_lines": (markdown_lines, _MARKDOWN),
    "token_ids": (token_ids, "SELECT doc_id, CAST(length(text) AS INTEGER) AS n, CAST(coalesce(list_sum(list_transform(range(1, length(text) + 1), lambda i: unicode(substr(text, i, 1)))), 0) AS BIGINT) AS total FROM documents WHERE text IS NOT NULL"),
    "padded_blocks": (padded_blocks, "SELECT doc_id, 256 AS n, CAST(coalesce(list_sum(list_transform(range(1, least(length(text), 256) + 1), lambda i: unicode(substr(text, i, 1)))), 0) AS BIGINT) AS total, CAST(least(length(text), 256) AS BIGINT) AS real, CAST((length(text) + 3) // 4 * 4 AS INTEGER) AS multiple FROM documents WHERE text IS NOT NULL"),
    "pack_blocks": (pack_blocks, _PACK.format(g="CAST(0 AS BIGINT)")),
    "pack_blocks_grouped": (pack_blocks_grouped, _PACK.format(g="doc_id // 1000")),
    "sft_encode": (sft_encode, f"WITH {_SFT} SELECT conv_id, pair, CAST(n_src AS INTEGER) AS n_src, CAST(n_tgt AS INTEGER) AS n_tgt FROM enc"),
    "sft_masks": (sft_masks, f"WITH {_SFT} SELECT conv_id, CAST(sum(n_src + n_tgt + 1) AS INTEGER) AS n, CAST(sum(n_src) AS INTEGER) AS masked, CAST(sum(n_src + n_tgt + 1) AS INTEGER) AS mask FROM enc GROUP BY conv_id"),
    "context_cut": (context_cut, "SELECT doc_id, CAST(least(length(text), 192) AS INTEGER) AS n, CASE WHEN length(text) > 0 THEN unicode(substr(text, CAST(greatest(length(text) - 191, 1) AS INTEGER), 1)) END AS first FROM documents WHERE text IS NOT NULL"),
    "prompt_lengths": (prompt_lengths, f"SELECT qa_id, CAST(length(question) AS INTEGER) AS n FROM {_QA} WHERE length(question) BETWEEN 1 AND 100"),
}
