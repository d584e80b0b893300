"""Conversations as rows: ``conv_id, turn, role, text``, one row for each turn.

Turn order is the column ``turn``; nothing depends on the order of rows.  All
grouping is by ``conv_id``, so one shuffle on it serves a whole chain of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.text import strip, tidy_reply
from turnloom.functions.tools import format_call_value, format_observation
from turnloom.operators.sampling import in_ranges

# Roles as they are written, and what they become.
USERS = ("human", "user", "observation")
ASSISTANTS = ("gpt", "assistant", "function_call")


def to_turns(df: DataFrame, conv_id: str, conversations: str = "conversations") -> DataFrame:
    """Long form of an array of (from, value).  A conversation delivered twice counts once; its key must be unique
    otherwise.  A missing role or text is an empty one."""
    once = df.select(F.col(conv_id).alias("conv_id"), F.col(conversations).alias("c")).dropDuplicates(["conv_id"])
    t = once.select("conv_id", F.posexplode("c").alias("turn", "m"))
    return t.select("conv_id", "turn", F.coalesce(t.m["from"], F.lit("")).alias("role"), F.coalesce(t.m["value"], F.lit("")).alias("text"))


def to_conversations(turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Back to one row for each conversation: an array of (role, content) in order."""
    m = F.array_sort(F.collect_list(F.struct("turn", F.col(role).alias("role"), F.col(text).alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def normalized_roles(turns: DataFrame, tool_format: str | None = None, format_tools: bool = False) -> DataFrame:
    """Roles become ``user`` and ``assistant``; system turns and unknown roles fall out.  With ``format_tools``, calls
    and results are written in the dialect."""
    role = F.when(F.col("role").isin(*USERS), "user").when(F.col("role").isin(*ASSISTANTS), "assistant")
    text = F.col("text")
    if format_tools:
        text = F.when(F.col("role") == "observation", format_observation(text, tool_format)).when(F.col("role") == "function_call", format_call_value(text, tool_format)).otherwise(text)
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).where("role is not null")


def system_prompts(turns: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """``conv_id, system_prompt``: the last system turn of each conversation; with a fallback table of the same columns
    that one where it is empty."""
    found = turns.groupBy("conv_id").agg(F.coalesce(F.max_by(F.col("text"), F.when(F.col("role") == "system", F.col("turn"))), F.lit("")).alias("system_prompt"))
    if fallback is None:
        return found
    other = fallback.select("conv_id", F.col("system_prompt").alias("other"))
    return found.join(other, "conv_id", "left").select("conv_id", F.coalesce(F.nullif("system_prompt", F.lit("")), "other", F.lit("")).alias("system_prompt"))


def with_tools(system_prompt: Column, tools: Column) -> Column:
    """The tools' text after the system prompt, a blank line between them where there are both."""
    return F.concat_ws("\n\n", F.nullif(system_prompt, F.lit("")), F.nullif(tools, F.lit("")))


def _in_order() -> object:
    return Window.partitionBy("conv_id").orderBy("turn")


def paired(turns: DataFrame, keep_open: bool = False) -> DataFrame:
    """Fold into ``conv_id, pair, question, answer``: users in a row are joined by line feeds, the first assistant after
    them closes the pair, further ones and leading ones are dropped.  ``keep_open``: a last question without an answer
    stays, with an empty one."""
    before = _in_order().rowsBetween(Window.unboundedPreceding, -1)
    answered = F.coalesce(F.sum((F.col("role") == "assistant").cast("int")).over(before), F.lit(0))
    grouped = turns.withColumn("g", answered).groupBy("conv_id", "g").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda x: x["text"]), "\n").alias("question"),
        F.count_if(F.col("role") == "user").alias("users"),
        F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("answer"),
    )
    kept = grouped.where("users > 0" if keep_open else "users > 0 and answer is not null")
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("g")) - 1
    return kept.select("conv_id", nth.alias("pair"), "question", F.coalesce("answer", F.lit("")).alias("answer"))


def strictly_alternating(turns: DataFrame) -> DataFrame:
    """Pairs of conversations that strictly alternate.  A first turn that isn't human is left out; reading stops at the
    first role other than human and gpt; turn j stays only if it has the role of its place; what remains must be even
    and not empty.  At least two turns are needed before and after leaving out the first."""
    w = Window.partitionBy("conv_id")
    nth = F.row_number().over(w.orderBy("turn")) - 1
    t = turns.withColumn("n", nth).withColumn("size", F.count("*").over(w)).withColumn("skip", F.max(((F.col("n") == 0) & (F.col("role") != "human")).cast("int")).over(w))
    t = t.where((F.col("size") >= 2) & (F.col("size") - F.col("skip") >= 2) & (F.col("n") >= F.col("skip"))).withColumn("n", F.col("n") - F.col("skip"))
    stopped = F.max((~F.col("role").isin("human", "gpt")).cast("int")).over(w.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("stopped", stopped).where((F.col("stopped") == 0) & (F.col("role") == F.when(F.col("n") % 2 == 0, "human").otherwise("gpt")))
    t = t.withColumn("left", F.count("*").over(w)).where("left % 2 = 0").withColumn("k", F.row_number().over(w.orderBy("n")) - 1)
    pair = F.floor(F.col("k") / 2).cast("int")
    return t.groupBy("conv_id", pair.alias("pair")).agg(F.max(F.when(F.col("k") % 2 == 0, F.col("text"))).alias("question"), F.max(F.when(F.col("k") % 2 == 1, F.col("text"))).alias("answer"))


def prefixes(turns: DataFrame) -> DataFrame:
    """One row for each assistant turn after the first user: ``conv_id, turn, messages``, all turns up to it in order."""
    seen = _in_order().rowsBetween(Window.unboundedPreceding, 0)
    t = turns.withColumn("messages", F.collect_list(F.struct("role", F.col("text").alias("content"))).over(seen))
    t = t.withColumn("users", F.count_if(F.col("role") == "user").over(seen))
    return t.where("role = 'assistant' and users > 0").select("conv_id", "turn", "messages")


def messages(turns: DataFrame, systems: DataFrame) -> DataFrame:
    """``conv_id, messages``: the system prompt first, if there is one, then all turns."""
    head = F.when(F.col("system_prompt") != "", F.array(F.struct(F.lit("system").alias("role"), F.col("system_prompt").alias("content"))))
    return to_conversations(turns).join(systems, "conv_id", "left").select("conv_id", F.when(head.isNotNull(), F.concat(head, "messages")).otherwise(F.col("messages")).alias("messages"))


def dialog_prompts(dialog: DataFrame) -> DataFrame:
    """Every prompt segment of a list of prompts and replies in turn: ``conv_id, pair, prompt``."""
    return dialog.select("conv_id", F.posexplode("dialog").alias("pos", "prompt")).where("pos % 2 = 0").select("conv_id", (F.col("pos") / 2).cast("int").alias("pair"), "prompt")


def carried_forward(turns: DataFrame, across: bool = False) -> DataFrame:
    """``conv_id, turn, question, answer``: each gpt turn with the last human turn before it.  ``across`` looks back over
    earlier conversations too, in order of ``conv_id``: within ranges of that order first, then from range to range."""
    said = F.when(F.col("role") == "human", F.col("text"))
    asked = lambda w: F.last(said, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if not across:
        rows = turns.withColumn("question", asked(Window.partitionBy("conv_id").orderBy("turn")))
    else:
        rows = in_ranges(turns, "conv_id", "turn")
        ends = rows.groupBy("_b").agg(F.max_by(said, F.when(said.isNotNull(), F.col("_nth"))).alias("_last"))
        before = F.last("_last", ignorenulls=True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
        rows = rows.withColumn("question", asked(Window.partitionBy("_b").orderBy("_nth"))).join(F.broadcast(ends.select("_b", before.alias("_before"))), "_b")
        rows = rows.withColumn("question", F.coalesce("question", "_before"))
    return rows.where("role = 'gpt' and question is not null").select("conv_id", "turn", "question", F.col("text").alias("answer"))


def last_answer_replaced(pairs: Column, text: Column) -> Column:
    """A list of (question, answer) with another last answer."""
    n = F.size(pairs)
    last = F.array(F.struct(F.try_element_at(pairs, F.lit(-1))["question"].alias("question"), text.alias("answer")))
    return F.when(n > 0, F.concat(F.slice(pairs, F.lit(1), n - 1), last))


def preference_messages(df: DataFrame, messages: str = "messages", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """The messages with the chosen and with the rejected reply at their end."""
    said = lambda c: F.concat(F.col(messages), F.array(F.struct(F.lit("assistant").alias("role"), F.col(c).alias("content"))))
    return df.withColumns({"chosen_messages": said(chosen), "rejected_messages": said(rejected)})


def unpivoted(df: DataFrame, key: str, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """A row for the chosen and one for the rejected reply."""
    return df.select(key, F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("text")) for k, c in (("chosen", chosen), ("rejected", rejected))))))


def transcript_turns(df: DataFrame, key: str, text: str, human: str = "患者", gpt: str = "护士") -> DataFrame:
    """Turns of a written dialogue: lines that start with a speaker's name; the text is what follows the name up to its
    next occurrence, stripped, without its first character, the colon."""
    line = df.select(F.col(key).alias("conv_id"), F.posexplode(F.split(strip(text), "\n")).alias("turn", "line"))
    who = F.when(F.startswith("line", F.lit(human)), human).when(F.startswith("line", F.lit(gpt)), gpt)
    line = line.withColumn("who", who).where("who is not null")
    said = F.substring(strip(F.split_part("line", "who", F.lit(2))), 2, 1 << 30)
    return line.select("conv_id", "turn", F.when(F.col("who") == human, "human").otherwise("gpt").alias("role"), said.alias("text"))


def rolling_history(turns: DataFrame, k: int) -> DataFrame:
    """Each turn with the last k turns before it, joined by line feeds."""
    w = _in_order().rowsBetween(-k, -1)
    return turns.withColumn("history", F.array_join(F.collect_list("text").over(w), "\n"))


def react_history(df: DataFrame, messages: str = "messages", instruction: str = "", tools: bool = False) -> DataFrame:
    """Chat requests into ``query``, ``history`` (question, answer), ``system`` and ``error``.  Results of functions and
    further replies are written after the reply before them.  Requests that break the order of roles have the
    reason in ``error`` and nulls elsewhere.  ``instruction`` goes before the last question."""
    m = F.col(messages)
    first = F.get(m, 0)
    has_system = F.coalesce(first["role"] == "system", F.lit(False))
    body = F.when(has_system, F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(1)))).otherwise(m)
    n = F.size(body)
    turn = "struct<role:string,content:string>"
    start = F.expr(f"named_struct('out', cast(array() as array<{turn}>), 'error', cast(null as string), 'i', 0)")

    def step(acc: Column, x: Column) -> Column:
        content = tidy_reply(F.coalesce(x["content"], F.lit("")))
        out, role = acc["out"], x["role"]
        last = F.get(out, F.size(out) - 1)
        call = F.concat(F.when(F.startswith(content, F.lit("Thought:")), content).otherwise(F.concat(F.lit("Thought: "), content)), F.lit("\nAction: "), x["tool_calls"]["name"], F.lit("\nAction Input: "), x["tool_calls"]["arguments"])
        plain = F.concat(F.lit("Thought: I now know the final answer.\nFinal Answer: "), content) if tools else content
        reply = F.when(x["tool_calls"].isNull(), plain).otherwise(call)
        result = F.concat(F.lit("\nObservation: "), content, F.when(acc["i"] == n - 1, F.lit("\nThought:")).otherwise(F.lit("")))
        error = (
            F.when((role == "function") & ((F.size(out) == 0) | (last["role"] != "assistant")), "function before assistant")
            .when((role == "assistant") & (F.size(out) == 0), "assistant before user")
            .when(~role.isin("user", "assistant", "function"), F.concat(F.lit("unknown role "), role))
        )
        new = lambda r, c: F.array(F.struct(F.lit(r).alias("role"), c.alias("content")))
        grown = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last["role"].alias("role"), F.concat(last["content"], F.when(role == "function", result).otherwise(F.concat(F.lit("\n"), reply))).alias("content"))))
        next_ = F.when(acc["error"].isNotNull() | error.isNotNull(), out).when(role == "user", F.concat(out, new("user", content))).when((role == "assistant") & (last["role"] == "user"), F.concat(out, new("assistant", tidy_reply(reply)))).otherwise(grown)
        return F.struct(next_.alias("out"), F.coalesce(acc["error"], error).alias("error"), (acc["i"] + 1).alias("i"))

    folded = df.withColumn("_f", F.aggregate(body, start, step))
    out = F.col("_f.out")
    asks = F.coalesce(F.try_element_at(out, F.lit(-1))["role"] == "user", F.lit(False))
    turns = F.when(asks, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out)
    wrong = F.exists(F.transform(turns, lambda x, i: x["role"] != F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x)
    error = F.when(~F.exists(m, lambda x: x["role"] == "user"), "no user message").otherwise(F.coalesce(F.col("_f.error"), F.when((F.size(turns) % 2 != 0) | wrong, "roles do not alternate")))
    told = lambda q: F.concat(F.lit(instruction + "\n\nQuestion: "), q)
    pairs = F.transform(
        F.filter(turns, lambda x, i: i % 2 == 0),
        lambda x, i: F.struct((F.when(i == F.size(turns) / 2 - 1, told(x["content"])).otherwise(x["content"]) if instruction else x["content"]).alias("question"), F.get(turns, (2 * i + 1).cast("int"))["content"].alias("answer")),
    )
    query = F.when(asks, F.try_element_at(out, F.lit(-1))["content"])
    if instruction:
        query = F.when(F.size(turns) == 0, told(query)).otherwise(query)
    kept = df.columns
    system = F.when(has_system, tidy_reply(first["content"])).otherwise("")
    good = error.isNull()
    return folded.select(*kept, F.when(good, query).alias("query"), F.when(good, pairs).alias("history"), F.when(good, system).alias("system"), error.alias("error"))


def history_messages(history: Column) -> Column:
    """(question, answer) pairs as messages; empty texts give none."""
    both = F.flatten(F.transform(history, lambda p: F.array(F.struct(F.lit("user").alias("role"), p["question"].alias("content")), F.struct(F.lit("assistant").alias("role"), p["answer"].alias("content")))))
    return F.filter(both, lambda x: F.coalesce(x["content"], F.lit("")) != "")
