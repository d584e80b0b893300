"""Rows of one shape into rows of another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.text import strip
from turnloom.operators.sampling import ranked

# Fixed values.
REASONING_PROMPT = (
    "A conversation between User and Assistant. The user asks a question, and the Assistant solves it. The assistant first thinks about the reasoning process in the mind and then provides the user with the answer. "
    "The reasoning process and answer are enclosed within <think> </think> and <answer> </answer> tags, respectively, i.e., <think> reasoning process here </think><answer> answer here </answer>"
)
STEP_BY_STEP = "Let's think step by step and output the final answer within \\boxed{}."
NO_SOLUTION = "No solution available."


def turn(role: str, text: Column, a: str = "from", b: str = "value") -> Column:
    return F.struct(F.lit(role).alias(a), text.alias(b))


def qa_to_conversation(question: str, answer: str) -> Column:
    return F.array(turn("human", F.col(question)), turn("gpt", F.col(answer)))


def alpaca_to_conversation(instruction: str = "instruction", entry: str = "input", output: str = "output") -> Column:
    """The input follows the instruction after a blank line, where it isn't blank."""
    more = F.coalesce(F.length(strip(F.col(entry))) > 0, F.lit(False))
    return F.array(turn("human", F.when(more, F.concat(F.col(instruction), F.lit("\n\n"), F.col(entry))).otherwise(F.col(instruction))), turn("gpt", F.col(output)))


def problems_to_conversations(df: DataFrame, source: str, order: str, problem: str = "problem", solution: str = "solution") -> DataFrame:
    """``id`` (source and place in the order of a unique key, from 0) and ``conversations``."""
    asked = F.concat(F.col(problem), F.lit(" " + STEP_BY_STEP))
    answer = F.coalesce(F.nullif(F.col(solution), F.lit("")), F.lit(NO_SOLUTION))
    return ranked(df, order).select(F.concat(F.lit(f"{source}-"), F.col("place").cast("string")).alias("id"), F.array(turn("human", asked), turn("gpt", answer)).alias("conversations"))


def rl_prompt(df: DataFrame, question: str = "question") -> DataFrame:
    """Adds ``prompt``: the reasoning system prompt and the question; all columns stay."""
    return df.withColumn("prompt", F.array(turn("system", F.lit(REASONING_PROMPT), "role", "content"), turn("user", F.col(question), "role", "content")))


def aligned(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly these columns with these types, in this order; missing ones are null."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))


def only(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


def items_to_conversations(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("items", "conversations") if "conversations" not in df.columns else df


def as_messages(m: Column) -> Column:
    """Exactly role and content."""
    return F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))


def attention_mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: F.lit(1))


def ends_with_assistant(m: Column) -> Column:
    """For a filter: lists that aren't empty and whose last message is the assistant's."""
    return F.coalesce(F.try_element_at(m, F.lit(-1))["role"] == "assistant", F.lit(False))


def zipped(a: Column, b: Column) -> Column:
    """Pairs of two lists up to the end of the shorter."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
