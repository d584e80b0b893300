"""Vocabularies as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.text import all_chinese, strip
from turnloom.operators.ranking import words


def read_pieces(lines: DataFrame, value: str = "value") -> DataFrame:
    """The first word of every line that isn't blank, each once."""
    t = strip(F.col(value))
    return lines.where(t != "").select(F.element_at(F.split(t, r"(?U)\s+"), 1).alias("piece")).distinct()


def read_frequencies(lines: DataFrame, value: str = "value", line_no: str | None = None) -> DataFrame:
    """``word, freq`` of lines of a word and its frequency.  With ``line_no`` in order: the most frequent first, ties by
    line."""
    parts = F.split(strip(F.col(value)), r"(?U)\s+")
    rows = lines.where(F.size(parts) > 1).withColumns({"word": F.get(parts, 0), "freq": F.get(parts, 1).try_cast("bigint")}).where("freq is not null")
    return (rows.orderBy(F.desc("freq"), line_no) if line_no else rows).select("word", "freq")


def word_counts(df: DataFrame, text: str, segment: Callable[[Column], Column] = words) -> DataFrame:
    """How often every word occurs in all rows.  ``segment``: from text to its words."""
    return df.select(F.explode(segment(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def most_frequent(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.desc("freq"), "word").limit(n)


def merged(base: DataFrame, pieces: DataFrame, counts: DataFrame | None = None, n: int = 0) -> DataFrame:
    """``piece, source, score``: the base, then pieces that it lacks, then of the n most frequent words those that both
    lack.  Only Chinese words are added from the counts."""
    one = base.select("piece").distinct().withColumn("source", F.lit("base"))
    two = pieces.select("piece").distinct().join(one, "piece", "left_anti").withColumn("source", F.lit("domain"))
    out = one.unionByName(two)
    if counts is not None:
        top = most_frequent(counts, n).select(F.col("word").alias("piece")).where(all_chinese(F.col("piece"))).distinct()
        out = out.unionByName(top.join(out, "piece", "left_anti").withColumn("source", F.lit("words")))
    return out.withColumn("score", F.lit(0.0))
