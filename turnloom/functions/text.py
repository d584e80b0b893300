"""Scalar functions on text.  All are expressions of built-ins, but for brace matching."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: ColumnOrName) -> Column:
    """Without white space of any script at either end (SQL ``trim`` takes blanks only)."""
    return F.regexp_replace(_c(x), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def strip_start(x: ColumnOrName) -> Column:
    return F.regexp_replace(_c(x), r"(?U)^[\s\x1c-\x1f]+", "")


def strip_end(x: ColumnOrName) -> Column:
    return F.regexp_replace(_c(x), r"(?U)[\s\x1c-\x1f]+\z", "")


def tidy_reply(x: ColumnOrName) -> Column:
    """Without line feeds at the start and white space at the end."""
    return strip_end(F.regexp_replace(_c(x), r"^\n+", ""))


def normalized(x: ColumnOrName) -> Column:
    """Lower case, one blank for each run of white space, none at the ends; null gives an empty text."""
    return F.regexp_replace(F.lower(strip(F.coalesce(_c(x), F.lit("")))), r"(?U)[\s\x1c-\x1f]+", " ")


def extracted_answer(x: ColumnOrName) -> Column:
    """What the first ``<answer>`` element holds, else the whole text, stripped; null gives an empty text."""
    text = F.coalesce(_c(x), F.lit(""))
    pattern = r"(?s)<answer>(.*?)</answer>"
    return strip(F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text))


def format_reward(x: ColumnOrName) -> Column:
    """1.0 if the text starts with thoughts on one line, directly followed by an answer on one line that ends it."""
    return F.coalesce(_c(x).rlike(r"(?d)^<think>.*?</think><answer>.*?</answer>$"), F.lit(False)).cast("double")


def gold_answer(x: ColumnOrName) -> Column:
    """What follows the first ``####``, else the whole text, stripped."""
    return strip(F.when(F.contains(_c(x), F.lit("####")), F.element_at(F.split(_c(x), "####", 2), 2)).otherwise(_c(x)))


def accuracy_reward(reply: ColumnOrName, gold: ColumnOrName, equal: Callable[[Column, Column], Column] | None = None) -> Column:
    """1.0 if the reply's answer equals the gold answer, as a number, as normalised text, or by ``equal``: a function of
    the two answers (a Pandas UDF, for instance, that compares them as formulas); null counts as false."""
    a, b = extracted_answer(reply), gold_answer(gold)
    number = lambda s: F.regexp_replace(s, r"[,$\s]", "").try_cast("decimal(38,10)")
    same = F.coalesce(number(a) == number(b), F.lit(False)) | (normalized(a) == normalized(b))
    if equal is not None:
        same = same | F.coalesce(equal(a, b), F.lit(False))
    return F.coalesce(same & (b != ""), F.lit(False)).cast("double")


def boxed(x: ColumnOrName) -> Column:
    """The last ``\\boxed{...}``, or where there is none the last ``\\fbox{...}``, with its braces matched; ``\\boxed `` up
    to the next dollar sign; null if there is none or its braces aren't closed."""
    text = _c(x)
    spaced = F.concat(F.lit("\\boxed "), F.element_at(F.split(F.element_at(F.split(text, r"\\boxed ", -1), -1), r"\$", 2), 1))
    at = F.when(_last_at(text, "\\boxed") > 0, _last_at(text, "\\boxed")).otherwise(_last_at(text, "\\fbox"))
    tail = F.substr(text, at)
    # depth after every brace; the box ends where it first comes back to nothing
    chars = F.split(tail, "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc: Column, ch: Column) -> Column:
        depth = acc["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        closed = acc["done"] | ((ch == "}") & (depth == 0))
        return F.struct(F.when(acc["done"], acc["depth"]).otherwise(depth).alias("depth"), F.when(acc["done"], acc["n"]).otherwise(acc["n"] + 1).alias("n"), closed.alias("done"))

    end = F.aggregate(chars, start, step)
    matched = F.when((at > 0) & end["done"], F.substr(tail, F.lit(1), end["n"]))
    return F.when(F.contains(text, F.lit("\\boxed ")), spaced).otherwise(matched)


def _last_at(text: Column, what: str) -> Column:
    """Place of the last occurrence, from 1; 0 if there is none."""
    before = F.length(F.substring_index(text, what, -1))
    return F.when(F.contains(text, F.lit(what)), F.length(text) - before - F.lit(len(what)) + 1).otherwise(0)


def unboxed(x: ColumnOrName) -> Column:
    """What a box holds; null for text that is no box."""
    text = _c(x)
    braced = F.when(F.startswith(text, F.lit("\\boxed{")) & F.endswith(text, F.lit("}")), F.substr(text, F.lit(8), F.length(text) - 8))
    return F.when(F.startswith(text, F.lit("\\boxed ")), F.substr(text, F.lit(8))).otherwise(braced)


def boxed_solution(x: ColumnOrName) -> Column:
    return unboxed(boxed(x))


def all_chinese(x: ColumnOrName) -> Column:
    """Whether every character lies in U+4E00 to U+9FA5; true for an empty text."""
    return _c(x).rlike("^[一-龥]*\\z")


def has_chinese(x: ColumnOrName) -> Column:
    """Whether some character lies in U+4E00 to U+9FFF."""
    return _c(x).rlike("[一-鿿]")


def cut_at_stop(x: ColumnOrName, stop: str) -> Column:
    """The text before the first occurrence of a stop string."""
    return F.substring_index(_c(x), stop, 1) if stop else _c(x)


def cut_at_stops(x: ColumnOrName, stops: Sequence[str]) -> Column:
    out = _c(x)
    for stop in stops:
        out = cut_at_stop(out, stop)
    return out


def expanded_stops(stops: ColumnOrName) -> Column:
    """The stop words and, where new and not empty, each without the line feeds at its start."""
    s = _c(stops)
    bare = F.filter(F.transform(s, lambda w: F.regexp_replace(w, r"^\n+", "")), lambda w: w != "")
    return F.array_distinct(F.concat(s, bare))


def keep_last(ids: ColumnOrName, context: int, new: int, spare: int = 8) -> Column:
    """The last ids of a list that leave room for ``new`` ids and some to spare in the context."""
    n = max(context - new - spare, 0)
    return F.when(F.size(_c(ids)) > n, F.slice(_c(ids), -n, n)).otherwise(_c(ids)) if n else F.slice(_c(ids), 1, 0)


def head_md5(content: ColumnOrName, size: int = 1 << 20) -> Column:
    """MD5 of the first mebibyte of a file's bytes."""
    return F.md5(F.substring(_c(content), 1, size))


def numbered_items(x: ColumnOrName) -> Column:
    """Paragraphs of a numbered list without their numbers: what follows the first full stop; empty ones dropped."""
    item = lambda p: F.when(F.contains(p, F.lit(".")), F.substr(p, F.length(F.substring_index(p, ".", 1)) + 2)).otherwise(p)
    parts = F.filter(F.transform(F.split(_c(x), "\n\n"), strip), lambda p: p != "")
    return F.filter(F.transform(parts, lambda p: strip(item(p))), lambda p: p != "")


def perplexity(loss: ColumnOrName) -> Column:
    """exp of a mean loss, infinity where it overflows."""
    return F.exp(_c(loss).cast("double"))


def rope_factor(length: int | ColumnOrName, trained: int) -> float | Column:
    """How many times the trained length a length is, rounded up; of a number or of a column."""
    return float(math.ceil(length / trained)) if isinstance(length, int) else F.ceil(_c(length) / trained).cast("double")
