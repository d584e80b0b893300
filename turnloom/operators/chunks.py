"""Long texts into chunks for retrieval."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.text import has_chinese, strip
from turnloom.session import ship_to_active

# Characters that end a line of a document.
LINE_ENDS = ".!?。！？…;；:：”’）】》」』〕〉〗〞〟»\"')]}"


def _folded(pieces: Column, size: int, joint: str) -> Column:
    """Greedy: a piece joins the chunk while both together are no longer than ``size`` (the joint doesn't count)."""
    start = F.expr("named_struct('out', cast(array() as array<string>), 'cur', '')")

    def step(acc: Column, piece: Column) -> Column:
        fits = (F.length(acc["cur"]) + F.length(piece) <= size) | (acc["cur"] == "")
        longer = F.concat(acc["cur"], F.when(acc["cur"] == "", "").otherwise(joint), piece)
        return F.struct(F.when(fits, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))).alias("out"), F.when(fits, longer).otherwise(piece).alias("cur"))

    end = F.aggregate(pieces, start, step)
    return F.when(end["cur"] == "", end["out"]).otherwise(F.concat(end["out"], F.array(end["cur"])))


def sentence_chunks(text: Column, size: int = 250) -> Column:
    """Sentences (a stop, exclamation or question mark and white space after it), packed up to ``size`` characters; a
    longer sentence is a chunk of its own."""
    return _folded(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"(?U)(?<=[.!?])\s+"), size, " ")


# Ends of Chinese sentences.
_WIDE_END = re.compile("[。！？\n]")


def wide_spans(text: str, size: int, overlap: int, segment: Callable[[str], list[str]] | None = None) -> list[str]:
    out, at = [], 0
    if segment is not None:  # a chunk grows by whole words
        cur = ""
        for word in segment(text):
            cur += word
            if len(cur) >= size or len(cur) > size - overlap and _WIDE_END.fullmatch(word[-1:]):
                out.append(cur)
                cur = ""
        return [*out, cur] if cur else out
    while at < len(text):
        end = _WIDE_END.search(text, at + max(size - overlap, 0), at + size)
        to = end.end() if end else at + size
        out.append(text[at:to])
        at = to
    return out


def wide_chunks(text: Column, size: int = 250, overlap: int = 50, segment: Callable[[str], list[str]] | None = None) -> Column:
    """Chinese text by words (``segment`` cuts a text into them; default: by characters): a chunk is closed at its full size, or after the end of a sentence
    once it is longer than the size less the overlap.  An Arrow function: one step for each chunk, where a fold in SQL
    would take one for each character."""
    ship_to_active()

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else wide_spans(t, size, overlap, segment))

    return split(text)


def overlapped(chunks: Column, overlap: int = 50) -> Column:
    """Each chunk but the last with the beginning of the next after a blank, stripped.  ``chunks`` should be a column of
    the table rather than a long expression, which would be worked out again for every chunk."""
    if overlap <= 0:
        return chunks
    return F.when(F.size(chunks) > 1, F.transform(chunks, lambda c, i: F.when(i < F.size(chunks) - 1, strip(F.concat(c, F.lit(" "), F.left(F.get(chunks, i + 1), F.lit(overlap))))).otherwise(c))).otherwise(chunks)


def document_chunks(df: DataFrame, key: str, text: str, size: int = 250, overlap: int = 50) -> DataFrame:
    """``key, chunk_no, chunk``: by characters if the text has any Chinese one, else by sentences."""
    t = F.col(text)
    chunks = F.when(has_chinese(t), wide_chunks(F.when(has_chinese(t), t), size, overlap)).otherwise(sentence_chunks(t, size))
    rows = df.where(t.isNotNull()).select(key, chunks.alias("_chunks"))
    return rows.select(key, F.posexplode(overlapped(F.col("_chunks"), overlap)).alias("chunk_no", "chunk"))


def merged_lines(df: DataFrame, page: str, line_no: str, text: str) -> DataFrame:
    """Stripped, nonblank lines of a page joined until one ends with a closing character: ``page, part, text``."""
    rows = df.select(page, line_no, strip(F.col(text)).alias("t")).where("t <> ''")
    ends = F.instr(F.lit(LINE_ENDS), F.right("t", F.lit(1))) > 0
    before = Window.partitionBy(page).orderBy(line_no).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("part", F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line_no, "t"))), lambda x: x["t"]), "")
    return rows.groupBy(page, "part").agg(joined.alias("text"))
