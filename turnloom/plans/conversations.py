"""Queries on conversations: name to (query, SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import tools as TL
from turnloom.operators import conversations as C
from turnloom.operators import projections as J
from turnloom.operators import rendering as R
from turnloom.session import table

TURNS = """
c AS (SELECT DISTINCT pref_id, conversations, tools, chosen, rejected FROM toolcall_dpo_zh_demo),
turns AS (SELECT pref_id AS conv_id, CAST(i - 1 AS INTEGER) AS turn, coalesce(conversations[i]."from", '') AS role, coalesce(conversations[i].value, '') AS text
  FROM (SELECT pref_id, conversations, unnest(range(1, len(conversations) + 1)) AS i FROM c)),
norm AS (SELECT conv_id, turn, CASE WHEN role IN ('human', 'user', 'observation') THEN 'user' ELSE 'assistant' END AS role, text FROM turns WHERE role IN ('human', 'user', 'observation', 'gpt', 'assistant', 'function_call')),
systems AS (SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'system'), '') AS system_prompt FROM turns GROUP BY conv_id),
grouped AS (SELECT conv_id, g, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user') AS question, max(text) FILTER (role = 'assistant') AS answer
  FROM (SELECT *, coalesce(sum(CAST(role = 'assistant' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM norm) GROUP BY conv_id, g),
open_pairs AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY g) - 1 AS INTEGER) AS pair, question, coalesce(answer, '') AS answer FROM grouped WHERE question IS NOT NULL),
pairs AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY g) - 1 AS INTEGER) AS pair, question, answer FROM grouped WHERE question IS NOT NULL AND answer IS NOT NULL)
"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    return C.to_turns(table(spark, d, "toolcall_dpo_zh_demo"), "pref_id")


def norm(spark: SparkSession, d: str) -> DataFrame:
    return C.normalized_roles(turns(spark, d))


def quoted(text: str) -> str:
    """A SQL literal, line feeds spelled out."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _prefs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "toolcall_dpo_zh_demo").dropDuplicates(["pref_id"])


def conv_turns(spark, d):
    return turns(spark, d)


def roles_normalized(spark, d):
    return norm(spark, d)


def roles_with_tools(spark, d):
    """All turns, calls as well as results, in the qwen dialect."""
    return C.normalized_roles(turns(spark, d), "qwen", format_tools=True)


def call_turns(spark, d):
    """Calls of the turns in the default dialect, read again from their text."""
    t = C.normalized_roles(turns(spark, d).where("role = 'function_call'"), "default", format_tools=True)
    return t.select("conv_id", "turn", TL.extract_calls(F.col("text"), "default").alias("x")).select("conv_id", "turn", "x.is_call", F.get("x.calls", 0)["name"].alias("name"))


def system_prompts(spark, d):
    return C.system_prompts(turns(spark, d))


def system_with_tools(spark, d):
    tools = _prefs(spark, d).select(F.col("pref_id").alias("conv_id"), "tools")
    both = C.system_prompts(turns(spark, d)).join(tools, "conv_id")
    return both.select("conv_id", C.with_tools(F.col("system_prompt"), F.col("tools")).alias("text"))


def messages_built(spark, d):
    t = turns(spark, d)
    m = C.messages(C.normalized_roles(t), C.system_prompts(t))
    return m.select("conv_id", F.size("messages").alias("n"), F.get("messages", 0)["role"].alias("first_role"), F.aggregate("messages", F.lit(0), lambda s, x: s + F.length(x["content"])).alias("chars"))


def conv_pairs(spark, d):
    return C.paired(norm(spark, d))


def conv_pairs_keep_open(spark, d):
    return C.paired(norm(spark, d), keep_open=True)


def conv_prefixes(spark, d):
    p = C.prefixes(norm(spark, d))
    return p.select("conv_id", "turn", F.size("messages").alias("n"), F.aggregate("messages", F.lit(0), lambda s, x: s + F.length(x["content"])).alias("chars"))


def strict_alternation(spark, d):
    return C.strictly_alternating(turns(spark, d))


def rl_prompts(spark, d):
    """Prompt segments of the strictly alternating conversations, empty ones left out."""
    seg = R.rendered_segments(C.strictly_alternating(turns(spark, d)), "vicuna")
    return C.dialog_prompts(R.rendered_dialogs(seg)).where("length(prompt) > 0")


def locf_pairs(spark, d):
    return C.carried_forward(turns(spark, d))


def rolling_history(spark, d):
    return C.rolling_history(turns(spark, d), 3).select("conv_id", "turn", "history")


def preference_unpivot(spark, d):
    return C.unpivoted(_prefs(spark, d), "pref_id")


def preference_replaced(spark, d):
    p = F.array_sort(F.collect_list(F.struct("pair", "question", "answer")))
    lists = C.paired(norm(spark, d), keep_open=True).groupBy("conv_id").agg(F.transform(p, lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer"))).alias("pairs"))
    both = lists.join(_prefs(spark, d).select(F.col("pref_id").alias("conv_id"), "chosen", "rejected"), "conv_id")
    text = lambda c: F.array_join(F.transform(C.last_answer_replaced(F.col("pairs"), F.coalesce(c, F.lit(""))), lambda x: F.concat(x["question"], F.lit("|"), x["answer"])), "\n")
    return both.select("conv_id", text(F.col("chosen")).alias("chosen_text"), text(F.col("rejected")).alias("rejected_text"))


def preference_messages(spark, d):
    t = turns(spark, d)
    m = C.messages(C.normalized_roles(t), C.system_prompts(t)).join(_prefs(spark, d).select(F.col("pref_id").alias("conv_id"), "chosen", "rejected"), "conv_id")
    m = C.preference_messages(m.na.fill("", ["chosen", "rejected"]))
    one = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")
    return m.select("conv_id", one(F.col("chosen_messages")).alias("chosen_text"), one(F.col("rejected_messages")).alias("rejected_text"))


def dpo_triples(spark, d):
    """Prompt, chosen and rejected of every preference, by the characters of prompt and reply."""
    from turnloom.operators.sampling import char_pair_filter

    t = turns(spark, d)
    pairs = C.paired(C.normalized_roles(t), keep_open=True)
    prompts = R.rendered_prompts(R.rendered_segments(pairs, "vicuna", C.system_prompts(t)))
    both = prompts.join(_prefs(spark, d).select(F.col("pref_id").alias("conv_id"), "chosen", "rejected"), "conv_id").na.fill("", ["chosen", "rejected"])
    return char_pair_filter(both, "prompt", "chosen", "rejected", 600)


def ending_with_assistant(spark, d):
    return C.to_conversations(norm(spark, d)).where(J.ends_with_assistant(F.col("messages"))).select("conv_id", F.size("messages").alias("n"))


def render_dialog(spark, d):
    t = turns(spark, d)
    return R.rendered_segments(C.paired(C.normalized_roles(t)), "vicuna", C.system_prompts(t))


def render_prompt(spark, d):
    return R.rendered_prompts(render_dialog(spark, d))


def render_by_template(spark, d):
    """Every conversation by a template of its own, from the table of templates."""
    names = F.array(*(F.lit(t.name) for t in R.TEMPLATES))
    pairs = conv_pairs(spark, d)
    which = pairs.select("conv_id").distinct().select("conv_id", F.get(names, (F.col("conv_id") % len(R.TEMPLATES)).cast("int")).alias("name"))
    return R.rendered_prompts(R.rendered_segments(pairs, which))


def template_registry(spark, d):
    return R.template_table(spark)


def chat_rendering(spark, d):
    t = turns(spark, d)
    m = C.messages(C.normalized_roles(t), C.system_prompts(t))
    return m.select("conv_id", R.chat_text(F.col("messages"), add_prompt=True).alias("prompt"))


def incremental_segments(spark, d):
    p = C.prefixes(norm(spark, d)).select("conv_id", "turn", R.chat_text(F.col("messages")).alias("text"))
    return R.suffix_segments(p, "conv_id", "turn", "text").select("conv_id", "turn", "segment")


def guarded_text(spark, d):
    return render_prompt(spark, d).select("conv_id", R.guarded(F.col("prompt"), "<s>", "</s>").alias("text"))


def growing_stream(spark, d):
    """Turns as tokens of a stream: the text after each, cut at a stop string."""
    from turnloom.operators.tokens import growing_text

    return growing_text(turns(spark, d), "conv_id", "turn", "text", "，别").select("conv_id", "turn", F.length("text").alias("chars"))


def stopped_stream(spark, d):
    from turnloom.operators.tokens import before_stop

    return before_stop(turns(spark, d), "conv_id", "turn", "text", "尾号").select("conv_id", "turn")


def observation_format(spark, d):
    t = turns(spark, d).where("role = 'observation'")
    return t.select("conv_id", "turn", *(TL.format_observation(F.col("text"), k).alias(n) for n, k in (("qwen", "qwen3"), ("glm4", "glm4"), ("mistral", "mistral"), ("other", None))))


def function_format(spark, d):
    """Calls of one and the same name and text in every dialect."""
    t = turns(spark, d).where("role = 'function_call'").withColumn("calls", F.array(F.struct(F.lit("f").alias("name"), F.col("text").alias("arguments"))))
    return t.select("conv_id", "turn", *(TL.format_calls(F.col("calls"), k).alias(k) for k in TL.DIALECTS))


def tools_rendered(spark, d):
    """The tool list of every record in all dialects; null where it has none."""
    p = _prefs(spark, d)
    return p.select("pref_id", *(TL.tools_prompt(F.col("tools"), k, F.lit("01 Jan 2024")).alias(k) for k in TL.DIALECTS))


def call_extracted(spark, d):
    """Name and arguments of the chosen calls."""
    x = _prefs(spark, d).select("pref_id", TL.extract_calls(F.col("chosen"), "default").alias("x"))
    call = F.get("x.calls", 0)
    return x.select("pref_id", "x.is_call", call["name"].alias("name"), call["arguments"].alias("arguments"))


def react_instructions(spark, d):
    return _prefs(spark, d).select("pref_id", TL.react_prompt(F.col("tools")).alias("text"))


def calls_read_back(spark, d):
    """Calls of the turns, written in every dialect and read again."""
    t = turns(spark, d).where("role = 'function_call'")
    call = F.from_json("text", "name string, arguments string")
    t = t.select("conv_id", "turn", F.array(F.struct(call["name"].alias("name"), F.regexp_extract("text", r'(?s)"arguments": (.*)\}$', 1).alias("arguments"))).alias("calls"))
    back = lambda k: F.get(TL.extract_calls(TL.format_calls(F.col("calls"), k), k)["calls"], 0)
    read = t.select("conv_id", "turn", *(back(k).alias(k) for k in TL.DIALECTS))
    return read.select("conv_id", "turn", *(F.concat(F.col(k)["name"], F.lit(" "), F.col(k)["arguments"]).alias(k) for k in TL.DIALECTS))


def own_template(spark, d):
    """Questions in a template of the user's own, which is known only as long as it is asked for."""
    R.register_template(R.Template("own_plain", "Q: {query}\nA:", "\n", "Be brief.", "Q:"))
    prompt = R.single_turn(F.col("question"), "own_plain")
    R.forget_template("own_plain")
    return table(spark, d, "qa_sample").dropDuplicates(["qa_id"]).select("qa_id", prompt.alias("prompt"))


def react_parse(spark, d):
    return _prefs(spark, d).select("pref_id", TL.react_parts(F.concat(F.lit("Thought: look\n"), F.col("chosen"))).alias("x")).select("pref_id", "x.content", "x.name", "x.arguments")


def react_requests(spark, d):
    """Conversations as chat requests, folded into a query and a history."""
    role = F.when(F.col("role") == "human", "user").when(F.col("role") == "gpt", "assistant").when(F.col("role") == "observation", "function").when(F.col("role") == "function_call", "assistant").otherwise(F.col("role"))
    call = F.when(F.col("role") == "function_call", F.struct(F.lit("f").alias("name"), F.col("text").alias("arguments")))
    m = F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), F.when(call.isNull(), F.col("text")).otherwise("").alias("content"), call.alias("tool_calls"))))
    r = turns(spark, d).groupBy("conv_id").agg(m.alias("messages"))
    return C.react_history(r, tools=True).select("conv_id", "query", F.size("history").alias("n_history"), F.try_element_at("history", F.lit(-1))["answer"].alias("last_answer"), "error")


def transcript(spark, d):
    """Turns of the dialogues that documents hold as text."""
    docs = table(spark, d, "documents").where("text is not null")
    return C.transcript_turns(docs, "doc_id", "text", "human", "gpt")


def _vicuna_parts() -> tuple[str, str, str]:
    t = R.template("vicuna")
    before, after = t.prompt.split("{query}")
    return quoted(t.system_prompt), quoted(before), quoted(after)


_SYS, _BEFORE, _AFTER = _vicuna_parts()
_SEGMENT = f"""(CASE WHEN pair > 0 THEN '</s>' ELSE coalesce(nullif(system_prompt, ''), {_SYS}) || '</s>' END) || {_BEFORE} || question || {_AFTER}"""
_TEMPLATE_ROWS = ", ".join(f"({i}, {quoted(t.name)}, {quoted(t.prompt)}, {quoted(t.sep)}, {quoted(t.system_prompt)}, {quoted(t.stop)})" for i, t in enumerate(R.TEMPLATES))
_MSGS = "msgs AS (SELECT conv_id, turn, role, text FROM norm UNION ALL SELECT conv_id, -1, 'system', system_prompt FROM systems WHERE system_prompt <> '')"
_ALT = """
a0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, count(*) OVER (PARTITION BY conv_id) AS size FROM turns),
a1 AS (SELECT *, max(CAST(n = 0 AND role <> 'human' AS INT)) OVER (PARTITION BY conv_id) AS skip FROM a0),
a2 AS (SELECT conv_id, n - skip AS n, role, text FROM a1 WHERE size >= 2 AND size - skip >= 2 AND n >= skip),
a3 AS (SELECT *, max(CAST(role NOT IN ('human', 'gpt') AS INT)) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS stopped FROM a2),
a4 AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS kept, row_number() OVER (PARTITION BY conv_id ORDER BY n) - 1 AS k FROM a3 WHERE stopped = 0 AND role = CASE WHEN n % 2 = 0 THEN 'human' ELSE 'gpt' END),
alt AS (SELECT conv_id, CAST(k // 2 AS INTEGER) AS pair, max(text) FILTER (k % 2 = 0) AS question, max(text) FILTER (k % 2 = 1) AS answer FROM a4 WHERE kept % 2 = 0 GROUP BY conv_id, k // 2)
"""

#: Tool lists in their parts; names of tools stand first in each.
_TOOLS = """tp AS (SELECT pref_id, CASE WHEN tools IS NULL OR tools IN ('', '[]') THEN [] ELSE string_split(substr(tools, 2, length(tools) - 2), '}, {"name": ') END AS raw FROM c),
tl AS (SELECT pref_id, len(raw) AS n, list_transform(range(1, len(raw) + 1), lambda i: CASE WHEN i > 1 THEN '{"name": ' ELSE '' END || raw[i] || CASE WHEN i < len(raw) THEN '}' ELSE '' END) AS parts FROM tp)"""

QUERIES = {
    "conv_pairs": (conv_pairs, f"WITH {TURNS} SELECT * FROM pairs"),
    "conv_pairs_keep_open": (conv_pairs_keep_open, f"WITH {TURNS} SELECT * FROM open_pairs"),
    "conv_turns": (conv_turns, f"WITH {TURNS} SELECT * FROM turns"),
    "roles_normalized": (roles_normalized, f"WITH {TURNS} SELECT * FROM norm"),
    "roles_with_tools": (roles_with_tools, f"""WITH {TURNS} SELECT conv_id, turn, CASE WHEN role IN ('gpt', 'function_call') THEN 'assistant' ELSE 'user' END AS role,
CASE WHEN role = 'observation' THEN '<tool_response>' || chr(10) || text || chr(10) || '</tool_response>' WHEN role = 'function_call' THEN CASE WHEN json_valid(text) THEN '<tool_call>' || chr(10) || '{{"name": "' || json_extract_string(text, '$.name') || '", "arguments": ' || regexp_extract(text, '(?s)"arguments": (.*)\\}}$', 1) || '}}' || chr(10) || '</tool_call>' END ELSE text END AS text
FROM turns WHERE role IN ('human', 'gpt', 'observation', 'function_call')"""),
    "call_turns": (call_turns, f"WITH {TURNS} SELECT conv_id, turn, true AS is_call, json_extract_string(text, '$.name') AS name FROM turns WHERE role = 'function_call'"),
    "system_prompts": (system_prompts, f"WITH {TURNS} SELECT * FROM systems"),
    "system_with_tools": (system_with_tools, f"WITH {TURNS} SELECT conv_id, concat_ws(chr(10) || chr(10), nullif(system_prompt, ''), nullif(tools, '')) AS text FROM systems JOIN c ON pref_id = conv_id"),
    "messages_built": (messages_built, f"WITH {TURNS}, {_MSGS} SELECT conv_id, CAST(count(*) AS INTEGER) AS n, arg_min(role, turn) AS first_role, CAST(sum(length(text)) AS INTEGER) AS chars FROM msgs GROUP BY conv_id"),
    "conv_prefixes": (conv_prefixes, f"WITH {TURNS} SELECT conv_id, turn, CAST(n AS INTEGER) AS n, CAST(chars AS INTEGER) AS chars FROM (SELECT conv_id, turn, role, count(*) OVER w AS n, sum(length(text)) OVER w AS chars, sum(CAST(role = 'user' AS INT)) OVER w AS users FROM norm WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE role = 'assistant' AND users > 0"),
    "strict_alternation": (strict_alternation, f"WITH {TURNS}, {_ALT} SELECT * FROM alt"),
    "rl_prompts": (rl_prompts, f"WITH {TURNS}, {_ALT} SELECT conv_id, pair, {_SEGMENT.replace('system_prompt', quoted(''))} AS prompt FROM alt"),
    "locf_pairs": (locf_pairs, f"WITH {TURNS} SELECT conv_id, turn, question, text AS answer FROM (SELECT *, last_value(CASE WHEN role = 'human' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS question FROM turns) WHERE role = 'gpt' AND question IS NOT NULL"),
    "rolling_history": (rolling_history, f"WITH {TURNS} SELECT conv_id, turn, coalesce(string_agg(text, chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS history FROM turns"),
    "preference_unpivot": (preference_unpivot, f"WITH {TURNS} SELECT pref_id, 'chosen' AS kind, chosen AS text FROM c UNION ALL SELECT pref_id, 'rejected', rejected FROM c"),
    "preference_replaced": (preference_replaced, f"WITH {TURNS}, n AS (SELECT *, max(pair) OVER (PARTITION BY conv_id) AS last FROM open_pairs) SELECT conv_id, string_agg(question || '|' || CASE WHEN pair = last THEN coalesce(chosen, '') ELSE answer END, chr(10) ORDER BY pair) AS chosen_text, string_agg(question || '|' || CASE WHEN pair = last THEN coalesce(rejected, '') ELSE answer END, chr(10) ORDER BY pair) AS rejected_text FROM n JOIN c ON pref_id = conv_id GROUP BY conv_id"),
    "preference_messages": (preference_messages, f"WITH {TURNS}, {_MSGS}, m AS (SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS t FROM msgs GROUP BY conv_id) SELECT conv_id, t || chr(10) || 'assistant:' || coalesce(chosen, '') AS chosen_text, t || chr(10) || 'assistant:' || coalesce(rejected, '') AS rejected_text FROM m JOIN c ON pref_id = conv_id"),
    "dpo_triples": (dpo_triples, f"WITH {TURNS}, p AS (SELECT conv_id, string_agg({_SEGMENT} || answer, '' ORDER BY pair) AS prompt FROM open_pairs JOIN systems USING (conv_id) GROUP BY conv_id) SELECT conv_id, prompt, coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected FROM p JOIN c ON pref_id = conv_id WHERE length(prompt || coalesce(chosen, '')) BETWEEN 1 AND 600 AND length(prompt || coalesce(rejected, '')) BETWEEN 1 AND 600"),
    "ending_with_assistant": (ending_with_assistant, f"WITH {TURNS} SELECT conv_id, CAST(count(*) AS INTEGER) AS n FROM norm GROUP BY conv_id HAVING arg_max(role, turn) = 'assistant'"),
    "render_dialog": (render_dialog, f"WITH {TURNS} SELECT conv_id, pair, {_SEGMENT} AS prompt, answer FROM pairs JOIN systems USING (conv_id)"),
    "render_prompt": (render_prompt, f"WITH {TURNS} SELECT conv_id, string_agg({_SEGMENT} || answer, '' ORDER BY pair) AS prompt FROM pairs JOIN systems USING (conv_id) GROUP BY conv_id"),
    "render_by_template": (render_by_template, f"WITH {TURNS}, t(i, name, prompt, sep, system_prompt, stop) AS (VALUES {_TEMPLATE_ROWS}) SELECT conv_id, string_agg(CASE WHEN pair > 0 THEN sep WHEN system_prompt <> '' THEN system_prompt || sep ELSE '' END || replace(prompt, '{{query}}', question) || answer, '' ORDER BY pair) AS prompt FROM pairs JOIN t ON i = conv_id % {len(R.TEMPLATES)} GROUP BY conv_id"),
    "template_registry": (template_registry, f"WITH t(i, name, prompt, sep, system_prompt, stop) AS (VALUES {_TEMPLATE_ROWS}) SELECT name, prompt, sep, system_prompt, stop FROM t"),
    "chat_rendering": (chat_rendering, f"WITH {TURNS}, {_MSGS} SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS prompt FROM msgs GROUP BY conv_id"),
    "incremental_segments": (incremental_segments, f"WITH {TURNS}, m AS (SELECT conv_id, turn, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS x, sum(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS users FROM norm), p AS (SELECT conv_id, turn, lag(turn, 1, -1) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM m WHERE role = 'assistant' AND users > 0) SELECT p.conv_id, p.turn, string_agg(x, '' ORDER BY m.turn) AS segment FROM p JOIN m ON m.conv_id = p.conv_id AND m.turn <= p.turn AND m.turn > p.before GROUP BY p.conv_id, p.turn"),
    "guarded_text": (guarded_text, f"WITH {TURNS}, p AS (SELECT conv_id, '<s>' || string_agg({_SEGMENT} || answer, '' ORDER BY pair) AS t FROM pairs JOIN systems USING (conv_id) GROUP BY conv_id) SELECT conv_id, CASE WHEN ends_with(t, '</s>') THEN t ELSE t || '</s>' END AS text FROM p"),
    "growing_stream": (growing_stream, f"WITH {TURNS} SELECT conv_id, turn, CAST(length(split_part(string_agg(text, '' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '，别', 1)) AS INTEGER) AS chars FROM turns"),
    "stopped_stream": (stopped_stream, f"WITH {TURNS} SELECT conv_id, turn FROM (SELECT *, max(CAST(contains(text, '尾号') AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS seen FROM turns) WHERE seen = 0"),
    "observation_format": (observation_format, f"WITH {TURNS} SELECT conv_id, turn, '<tool_response>' || chr(10) || text || chr(10) || '</tool_response>' AS qwen, '<|observation|>' || chr(10) || text AS glm4, '[TOOL_RESULTS] {{\"content\": ' || text || '}}[/TOOL_RESULTS]' AS mistral, 'Observation: ' || text AS other FROM turns WHERE role = 'observation'"),
    "function_format": (function_format, f"WITH {TURNS} SELECT conv_id, turn, 'Action: f' || chr(10) || 'Action Input: ' || text || chr(10) AS \"default\", 'f' || chr(10) || text AS glm4, '{{\"name\": \"f\", \"parameters\": ' || text || '}}' AS llama3, '[{{\"name\": \"f\", \"arguments\": ' || text || '}}]' AS mistral, '<tool_call>' || chr(10) || '{{\"name\": \"f\", \"arguments\": ' || text || '}}' || chr(10) || '</tool_call>' AS qwen FROM turns WHERE role = 'function_call'"),
    "tools_rendered": (tools_rendered, f"""WITH {TURNS}, {_TOOLS} SELECT pref_id, CASE WHEN n > 0 THEN {quoted(TL.DEFAULT_HEAD)} || list_aggregate(list_transform(parts, lambda x: '> Tool Name: ' || json_extract_string(x, '$.name') || chr(10) || 'Tool Description: ' || json_extract_string(x, '$.description') || chr(10) || 'Tool Args:' || chr(10)
|| list_aggregate(list_transform(json_keys(x, '$.parameters.properties'), lambda k: '  - ' || k || ' (' || json_extract_string(x, '$.parameters.properties.' || k || '.type') || CASE WHEN contains(json_extract(x, '$.parameters.required')::VARCHAR, '"' || k || '"') THEN ', required' ELSE '' END || '): ' || json_extract_string(x, '$.parameters.properties.' || k || '.description') || chr(10)), 'string_agg', '') || chr(10)), 'string_agg', '')
|| replace({quoted(TL.DEFAULT_TAIL.replace("{{", "{").replace("}}", "}"))}, '{{names}}', list_aggregate(list_transform(parts, lambda x: json_extract_string(x, '$.name')), 'string_agg', ', ')) END AS "default",
CASE WHEN n > 0 THEN {quoted(TL.GLM4_HEAD)} || list_aggregate(list_transform(parts, lambda x: chr(10) || chr(10) || '## ' || json_extract_string(x, '$.name') || chr(10) || chr(10) || json_pretty(x) || {quoted(TL.GLM4_TOOL.split("{body}")[1])}), 'string_agg', '') END AS glm4,
CASE WHEN n > 0 THEN {quoted(TL.LLAMA3_HEAD.format(date="01 Jan 2024"))} || list_aggregate(list_transform(parts, lambda x: json_pretty('{{"type": "function", "function": ' || x || '}}') || chr(10) || chr(10)), 'string_agg', '') END AS llama3,
CASE WHEN n > 0 THEN '[AVAILABLE_TOOLS] [' || list_aggregate(list_transform(parts, lambda x: '{{"type": "function", "function": ' || x || '}}'), 'string_agg', ', ') || '][/AVAILABLE_TOOLS]' END AS mistral,
CASE WHEN n > 0 THEN {quoted(TL.QWEN_HEAD)} || list_aggregate(list_transform(parts, lambda x: chr(10) || '{{"type": "function", "function": ' || x || '}}'), 'string_agg', '') || {quoted(TL.QWEN_TAIL)} END AS qwen FROM tl"""),
    "react_instructions": (react_instructions, f"""WITH {TURNS}, {_TOOLS}, nm AS (SELECT *, list_aggregate(list_transform(parts, lambda x: json_extract_string(x, '$.name')), 'string_agg', ', ') AS names FROM tl)
SELECT pref_id, CASE WHEN n > 0 THEN replace({quoted(TL.REACT_HEAD)}, '{{tools}}', list_aggregate(list_transform(parts, lambda x: replace(replace(replace(replace({quoted(TL.REACT_TOOL.replace("{description}", "{d}").replace("{parameters}", "{p}"))}, '{{model}}', json_extract_string(x, '$.name')), '{{human}}', json_extract_string(x, '$.name')), '{{d}}', json_extract_string(x, '$.description')), '{{p}}', regexp_extract(x, '(?s)"parameters": (.*)\\}}$', 1))), 'string_agg', chr(10) || chr(10))) || replace({quoted(TL.REACT_TAIL)}, '{{names}}', names) END AS text FROM nm"""),
    "calls_read_back": (calls_read_back, f"""WITH {TURNS}, x AS (SELECT conv_id, turn, json_extract_string(text, '$.name') || ' ' || regexp_extract(text, '(?s)"arguments": (.*)\\}}$', 1) AS c FROM turns WHERE role = 'function_call') SELECT conv_id, turn, c AS "default", c AS glm4, c AS llama3, c AS mistral, c AS qwen FROM x"""),
    "own_template": (own_template, "SELECT qa_id, 'Be brief.' || chr(10) || 'Q: ' || question || chr(10) || 'A:' AS prompt FROM (SELECT DISTINCT qa_id, question FROM qa_sample)"),
    "call_extracted": (call_extracted, f"""WITH {TURNS}, x AS (SELECT pref_id, regexp_extract(chosen, '(?s)Action:\\s*(\\w+)\\s*Action Input:\\s*(.+?)\\s*$', 1) AS n, regexp_extract(chosen, '(?s)Action:\\s*(\\w+)\\s*Action Input:\\s*(.+?)\\s*$', 2) AS a FROM c)
SELECT pref_id, coalesce(n <> '' AND json_valid(a), false) AS is_call, CASE WHEN n <> '' AND json_valid(a) THEN n END AS name, CASE WHEN n <> '' AND json_valid(a) THEN a END AS arguments FROM x"""),
    "react_parse": (react_parse, f"""WITH {TURNS}, x AS (SELECT pref_id, 'Thought: look' || chr(10) || chosen AS t FROM c), y AS (SELECT *, strpos(t, chr(10) || 'Action:') AS a, strpos(t, chr(10) || 'Action Input:') AS b FROM x), z AS (SELECT *, trim(substr(t, a + 8, b - a - 8), ' ' || chr(10) || chr(9)) AS nm FROM y)
SELECT pref_id, CASE WHEN t IS NULL THEN NULL WHEN a > 0 AND b > a AND nm <> '' THEN 'look' ELSE t END AS content, CASE WHEN a > 0 AND b > a AND nm <> '' THEN nm END AS name, CASE WHEN a > 0 AND b > a AND nm <> '' THEN trim(substr(t, b + 14), ' ' || chr(10) || chr(9)) END AS arguments FROM z"""),
    "react_requests": (react_requests, None),
    "transcript": (transcript, "WITH l AS (SELECT doc_id AS conv_id, CAST(i - 1 AS INTEGER) AS turn, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '^[\\s\\p{Z}\\x1c-\\x1f\\x0b\\x{85}]+|[\\s\\p{Z}\\x1c-\\x1f\\x0b\\x{85}]+$', '', 'g'), chr(10)) AS lines FROM documents WHERE text IS NOT NULL))), w AS (SELECT *, CASE WHEN starts_with(line, 'human') THEN 'human' WHEN starts_with(line, 'gpt') THEN 'gpt' END AS role FROM l) SELECT conv_id, turn, role, substr(regexp_replace(split_part(line, role, 2), '^[\\s\\p{Z}\\x1c-\\x1f\\x0b\\x{85}]+|[\\s\\p{Z}\\x1c-\\x1f\\x0b\\x{85}]+$', '', 'g'), 2) AS text FROM w WHERE role IS NOT NULL"),
}
