"""Prompts from conversations by templates.  Templates are a table; a template's row is a handful of strings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    name: str
    prompt: str
    sep: str
    system_prompt: str = ""
    stop: str = "</s>"


_CURIOUS = "A chat between a curious {0} and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the {0}'s questions."
_CHATML = "<|im_start|>user\n{query}<|im_end|>\n<|im_start|>assistant\n"
_HELPFUL = "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n"
# The prompt formats that the public chat models were trained with.
TEMPLATES = [
    Template("vicuna", "USER: {query} ASSISTANT:", "</s>", _CURIOUS.format("user")),
    Template("base", "{query}", "</s>"),
    Template("alpaca", "### Instruction:\n{query}\n\n### Response:\n", "\n\n", "Below is an instruction that describes a task. Write a response that appropriately completes the request."),
    Template("baichuan", "<reserved_102>{query}<reserved_103>", "</s>"),
    Template("baichuan2", "<reserved_106>{query}<reserved_107>", "</s>"),
    Template("ziya", "<human>:{query}\n<bot>:", "\n"),
    Template("linly", "User: {query}\nBot: ", "\n"),
    Template("chatglm", "问：{query}\n答：", "\n"),
    Template("chatglm2", "问：{query}\n\n答：", "\n\n"),
    Template("chatglm3", "<|user|>\n{query}<|assistant|>", "\n", stop="<|user|>"),
    Template("phoenix", "Human: <s>{query}</s>Assistant: ", "</s>", _CURIOUS.format("human") + "\n\n"),
    Template("belle", "Human: {query}\n\nBelle: ", "\n\n"),
    Template("aquila", "Human: {query}###Assistant:", "###", _CURIOUS.format("human")),
    Template("intern", "<|User|>:{query}<eoh>\n<|Bot|>:", "<eoa>\n", stop="<eoa>"),
    Template("intern2", _CHATML, "<|im_end|>\n", "<|im_start|>system\nYou are an AI assistant whose name is InternLM (书生·浦语).\n<|im_end|>\n", "<|im_end|>"),
    Template("starchat", "<|user|>\n{query}<|end|>\n<|assistant|>\n", "<|end|>\n", "<system>\n", "<|end|>"),
    Template(
        "llama2",
        "[INST] {query} [/INST]",
        "</s>",
        "<<SYS>>\nYou are a helpful, respectful and honest assistant. Always answer as helpfully as possible, while being safe. Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. "
        "Please ensure that your responses are socially unbiased and positive in nature.\n\nIf a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. "
        "If you don't know the answer to a question, please don't share false information.\n<</SYS>>\n\n",
    ),
    Template("llama3", "<|start_header_id|>user<|end_header_id|>\n\n{query}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>", "<|start_header_id|>system<|end_header_id|>\n\nYou are a helpful, excellent and smart assistant.", "<|eot_id|>"),
    Template("llama2-zh", "[INST] {query} [/INST]", "</s>", "[INST] <<SYS>>\nYou are a helpful assistant. 你是一个乐于助人的助手。\n<</SYS>>\n\n [/INST]"),
    Template("mistral", "[INST] {query} [/INST]", "</s>"),
    Template("xverse", "Human: {query}\n\nAssistant: ", "</s>"),
    Template("chatml", _CHATML, "<|im_end|>\n", "You are a helpful assistant.", "<|im_end|>"),
    Template("deepseek", "User: {query}\n\nAssistant:", "</s>"),
    Template("deepseek3", "<｜User｜>{query}<｜Assistant｜>", "</s>"),
    Template(
        "deepseekcoder",
        "### Instruction:\n{query}\n### Response:\n",
        "\n",
        "You are an AI programming assistant, utilizing the Deepseek Coder model, developed by Deepseek Company, and you only answer questions related to computer science. "
        "For politically sensitive questions, security and privacy issues, and other non-computer science questions, you will refuse to answer\n",
        "<|EOT|>",
    ),
    Template("yi", _CHATML, "\n", stop="<|im_end|>"),
    Template("orion", "Human: {query}\n\nAssistant: </s>", "</s>"),
    Template("cohere", "<|START_OF_TURN_TOKEN|><|USER_TOKEN|>{query}<|END_OF_TURN_TOKEN|><|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>", "</s>", "<BOS_TOKEN>"),
    *(Template(name, _CHATML, "\n", _HELPFUL, "<|im_end|>") for name in ("qwen", "qwen3", "qwen3_nothink", "qwen3_5", "qwen3_5_nothink")),
]
_REGISTRY = {t.name: t for t in TEMPLATES}


def register_template(t: Template) -> None:
    _REGISTRY[t.name] = t


def forget_template(name: str) -> None:
    """Undoes ``register_template``; the published templates stay."""
    if name not in {t.name for t in TEMPLATES}:
        _REGISTRY.pop(name, None)


def template(name: str, strict: bool = False) -> Template:
    """By name; an unknown one is an error.  ``strict`` gives the one template that is published with a placeholder that
    is no placeholder, so that its prompts drop the question, as it is."""
    if name not in _REGISTRY:
        raise KeyError(f"unknown template: {name}")
    t = _REGISTRY[name]
    return Template(t.name, t.prompt.replace("{query}", "{content}"), t.sep, t.system_prompt, t.stop) if strict and name == "deepseekcoder" else t


def template_table(spark: SparkSession) -> DataFrame:
    rows = [(t.name, t.prompt, t.sep, t.system_prompt, t.stop) for t in _REGISTRY.values()]
    return spark.createDataFrame(rows, "name string, prompt string, sep string, system_prompt string, stop string")


def filled(pattern: Column, value: Column, place: str = "{query}") -> Column:
    """The pattern with the value at its place; the value is taken literally."""
    return F.replace(pattern, F.lit(place), value)


def rendered_segments(pairs: DataFrame, name: str | DataFrame = "vicuna", systems: DataFrame | None = None) -> DataFrame:
    """``conv_id, pair, prompt, answer`` from ``conv_id, pair, question, answer``.  The first prompt has the system prompt
    and a separator before it, if there is one, all others a separator.  ``name`` may be a table ``conv_id, name``: then
    each conversation has its own template, from the small table of templates."""
    if isinstance(name, str):
        t = template(name)
        rows = pairs.withColumns({"_prompt": F.lit(t.prompt), "_sep": F.lit(t.sep), "_system": F.lit(t.system_prompt)})
    else:
        known = template_table(pairs.sparkSession).select("name", F.col("prompt").alias("_prompt"), F.col("sep").alias("_sep"), F.col("system_prompt").alias("_system"))
        rows = pairs.join(name, "conv_id").join(F.broadcast(known), "name")  # a table of a few dozen rows
    if systems is not None:
        rows = rows.join(systems.select("conv_id", F.col("system_prompt").alias("_own")), "conv_id", "left").withColumn("_system", F.coalesce(F.nullif("_own", F.lit("")), "_system"))
    head = F.when(F.col("pair") > 0, F.col("_sep")).when(F.col("_system") != "", F.concat("_system", "_sep")).otherwise("")
    return rows.select("conv_id", "pair", F.concat(head, filled(F.col("_prompt"), F.col("question"))).alias("prompt"), "answer")


def rendered_dialogs(segments: DataFrame) -> DataFrame:
    """``conv_id, dialog``: prompts and answers in turn."""
    parts = F.array_sort(F.collect_list(F.struct("pair", "prompt", "answer")))
    return segments.groupBy("conv_id").agg(F.flatten(F.transform(parts, lambda p: F.array(p["prompt"], p["answer"]))).alias("dialog"))


def rendered_prompts(segments: DataFrame) -> DataFrame:
    """``conv_id, prompt``: all segments one after another."""
    return rendered_dialogs(segments).select("conv_id", F.array_join("dialog", "").alias("prompt"))


def chat_text(messages: Column, add_prompt: bool = False) -> Column:
    """ChatML of a list of (role, content); with ``add_prompt`` the start of a reply after it."""
    one = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))
    text = F.array_join(F.transform(messages, one), "")
    return F.concat(text, F.lit("<|im_start|>assistant\n")) if add_prompt else text


def suffix_segments(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """What each cumulative text adds to the one before it."""
    before = F.lag(text).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("segment", F.substr(F.col(text), F.coalesce(F.length(before), F.lit(0)) + 1))


def guarded(text: Column, bos: str = "", eos: str = "") -> Column:
    """The text with BOS before it and EOS after it, where they aren't yet."""
    out = F.when(F.startswith(text, F.lit(bos)), text).otherwise(F.concat(F.lit(bos), text)) if bos else text
    return F.when(F.endswith(out, F.lit(eos)), out).otherwise(F.concat(out, F.lit(eos))) if eos else out


# Prompt of an answer from known passages.
RAG_PROMPT = (
    "基于以下已知信息，简洁和专业的来回答用户的问题。\n如果无法从中得到答案，请说 \"根据已知信息无法回答该问题\" 或 \"没有提供足够的相关信息\"，不允许在答案中添加编造成分，答案请使用中文。\n\n"
    "已知内容:\n{context_str}\n\n问题:\n{query_str}\n"
)
NO_CONTEXT = "没有提供足够的相关信息"


def rag_prompt(passages: Column, question: Column, context: int) -> Column:
    """The prompt with the passages, cut to what the context holds besides the template; without passages null."""
    room = max(context - len(RAG_PROMPT), 0)
    known = F.left(F.array_join(passages, "\n"), F.lit(room))
    return F.when(F.size(passages) > 0, filled(filled(F.lit(RAG_PROMPT), known, "{context_str}"), question, "{query_str}"))


def numbered_sources(passages: Column) -> Column:
    return F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit(']\t "'), p, F.lit('"')))


def single_turn(question: Column, name: str = "vicuna") -> Column:
    """A question on its own, rendered with the template and its system prompt."""
    t = template(name)
    return F.concat(F.lit(t.system_prompt + t.sep if t.system_prompt else ""), filled(F.lit(t.prompt), question))


# Texts of a dialogue of two roles to be written.
_ROLE_HEAD, _ROLE_FIRST, _ROLE_SECOND = "你是护士，跟患者对话。\n\n", "护士角色：", "\n患者角色："


def role_prompt(first: Column, second: Column) -> Column:
    return F.concat(F.lit(_ROLE_HEAD + _ROLE_FIRST), first, F.lit(_ROLE_SECOND), second)
