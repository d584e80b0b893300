"""The texts of the domain tables, one row for each record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def article_texts(lines: DataFrame, sep: str = " ") -> DataFrame:
    """``art_id`` and the whole article: its lines in order, joined.  A line delivered twice counts once, a null line
    is an empty one, lines without an article belong to none."""
    line = F.struct("line_no", "line_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_set(line)), lambda x: x["text"]), sep)
    return lines.where("art_id is not null").groupBy("art_id").agg(joined.alias("text"), F.first("lang", ignorenulls=True).alias("lang"))


def human_text(conversations: F.Column | str = "conversations", sep: str = "\n") -> F.Column:
    """All human turns in order, joined; null if there is no conversation."""
    c = F.col(conversations) if isinstance(conversations, str) else conversations
    return F.array_join(F.transform(F.filter(c, lambda x: x["from"] == "human"), lambda x: F.coalesce(x["value"], F.lit(""))), sep)


def last_human_turn(conversations: str = "conversations") -> F.Column:
    return F.element_at(F.transform(F.filter(F.col(conversations), lambda x: x["from"] == "human"), lambda x: x["value"]), -1)
