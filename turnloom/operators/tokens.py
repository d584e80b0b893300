"""Token lists: encoding, masking, padding, packing.

The built-in tokenizer takes code points as tokens, so results can be checked in
SQL; any function from text to a list of integers may stand in its place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators.sampling import in_ranges

IGNORED = -100
Tokenizer = Callable[[Column], Column]


def code_points(text: Column) -> Column:
    """One token for each character: its code point."""
    return F.when(F.length(text) > 0, F.transform(F.split(text, ""), lambda c: F.ascii(c))).otherwise(F.array().cast("array<int>"))


def tokenized(text: Column, tokenizer: Tokenizer = code_points, bos: int | None = None) -> Column:
    """Ids of a text; with ``bos`` that id before them."""
    ids = tokenizer(text)
    return F.concat(F.array(F.lit(bos)), ids) if bos is not None else ids


def padded(ids: Column, size: int, pad: int = 0) -> Column:
    """Cut or padded at the end to exactly ``size``."""
    short = F.slice(ids, 1, size)
    return F.concat(short, F.array_repeat(F.lit(pad), F.lit(size) - F.size(short)))


def padded_to_multiple(ids: Column, of: int, pad: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.pmod(-F.size(ids), F.lit(of))))


def padding_mask(ids: Column, size: int) -> Column:
    n = F.least(F.size(ids), F.lit(size))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(size) - n))


def with_eos(ids: Column, eos: int) -> Column:
    """EOS at the end, unless it is there already; of an empty list just EOS."""
    ends = F.coalesce(F.try_element_at(ids, F.lit(-1)) == eos, F.lit(False))
    return F.when(ends, ids).otherwise(F.concat(ids, F.array(F.lit(eos))))


def laid_out(df: DataFrame, key: str, size: str, per: Column) -> DataFrame:
    """Adds ``s``, the place of each row's first token in the order of the key, and ``total`` of its group.  Groups are
    summed in ranges of group and key first, as many as the shuffle has partitions, then ranges are added up, so that a
    group may be the whole table."""
    rows = in_ranges(df.withColumn("g", per), "g", key)
    own = F.coalesce(F.sum(size).over(Window.partitionBy("g", "_b").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy("g", "_b").agg(F.sum(size).alias("_n"))
    whole = Window.partitionBy("g").orderBy("_b")  # at most a row for each range
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("_n").over(Window.partitionBy("g")))
    return rows.withColumn("_own", own).join(sums.drop("_n"), ["g", "_b"]).withColumn("s", F.col("_own") + F.col("_before")).drop("_own", "_before", "_b", "_nth")


def packed_blocks(df: DataFrame, key: str, ids: str, block: int, eos: int, per: Column | None = None) -> DataFrame:
    """``g, block, input_ids, n_docs``: lists one after another, each ended by EOS, cut into blocks.  What is left over at
    the end of a group is dropped, unless it is all there is.  ``per`` groups the rows (default: all are one group).
    Rows of a block come together by its number; no group is held in one place."""
    rows = df.select(key, with_eos(F.col(ids), eos).alias("x")).withColumn("n", F.size("x").cast("bigint"))
    rows = laid_out(rows, key, "n", per if per is not None else F.lit(0).cast("bigint"))
    rows = rows.withColumn("e", F.col("s") + F.col("n"))
    parts = rows.select("*", F.explode(F.sequence(F.floor(F.col("s") / block), F.floor((F.col("e") - 1) / block))).alias("block"))
    lo, hi = F.greatest("s", F.col("block") * block), F.least("e", (F.col("block") + 1) * block)
    parts = parts.where((F.col("total") < block) | ((F.col("block") + 1) * block <= F.col("total")))
    parts = parts.select("g", "block", "s", F.slice("x", (lo - F.col("s") + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("s", "part"))), lambda p: p["part"]))
    return parts.groupBy("g", "block").agg(whole.alias("input_ids"), F.count("*").alias("n_docs"))


def block_rows(blocks: DataFrame) -> DataFrame:
    """Blocks with their mask and labels."""
    return blocks.withColumns({"attention_mask": F.transform("input_ids", lambda x: F.lit(1)), "labels": F.col("input_ids")})


def bordered_blocks(blocks: Column) -> Column:
    """A list without its first and last id."""
    return F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 2, F.lit(0)))


def supervised_lengths(pairs: DataFrame, most: int, source: str = "question", target: str = "answer", tokenizer: Tokenizer = code_points, eos: int = 2) -> DataFrame:
    """``conv_id, pair, src, tgt``: ids of each pair of a conversation, cut in proportion to what prompt and reply have of
    ``most`` in all; a leading EOS of the prompt and a trailing one of the reply are left out.  From the first pair that
    would not fit any more (with an EOS each), pairs are left out.  A pair without any token has none."""
    rows = pairs.select("conv_id", "pair", tokenizer(F.col(source)).alias("a"), tokenizer(F.col(target)).alias("b"))
    na, nb = F.size("a"), F.size("b")
    share = lambda n: F.coalesce(F.floor(F.lit(most) * n / F.nullif(na + nb, F.lit(0))), F.lit(0)).cast("int")
    a = F.slice("a", F.lit(1), F.least(na, share(na)))
    b = F.when(nb > share(nb), F.slice("b", F.lit(1), F.greatest(share(nb) - 1, F.lit(0)))).otherwise(F.col("b"))
    rows = rows.select("conv_id", "pair", a.alias("src"), b.alias("tgt"))
    first, last = F.try_element_at("src", F.lit(1)) == eos, F.try_element_at("tgt", F.lit(-1)) == eos
    rows = rows.withColumn("src", F.when(first, F.slice("src", F.lit(2), F.size("src"))).otherwise(F.col("src"))).withColumn("tgt", F.when(last, F.slice("tgt", F.lit(1), F.size("tgt") - 1)).otherwise(F.col("tgt")))
    upto = F.sum(F.size("src") + F.size("tgt") + 1).over(Window.partitionBy("conv_id").orderBy("pair"))
    return rows.withColumn("c", upto).where(F.col("c") <= most).drop("c")


def supervised_rows(encoded: DataFrame, eos: int = 2, on_inputs: bool = False, ignored: int = IGNORED) -> DataFrame:
    """``conv_id, input_ids, attention_mask, labels``: prompts are masked in the labels unless ``on_inputs``."""
    parts = F.array_sort(F.collect_list(F.struct("pair", "src", "tgt")))
    rows = encoded.groupBy("conv_id").agg(parts.alias("p"))
    end = F.array(F.lit(eos))
    ids = F.flatten(F.transform("p", lambda x: F.concat(x["src"], x["tgt"], end)))
    masked = F.flatten(F.transform("p", lambda x: F.concat(F.array_repeat(F.lit(ignored), F.size(x["src"])), x["tgt"], end)))
    rows = rows.select("conv_id", ids.alias("input_ids"), (ids if on_inputs else masked).alias("labels"))
    return rows.select("conv_id", "input_ids", F.transform("input_ids", lambda x: F.lit(1)).alias("attention_mask"), "labels")


def special_tokens(stop: str | None, eos: str | None = None, bos: str | None = None, pad: str | None = None, unk: str | None = None) -> dict[str, str]:
    """Special tokens with their defaults: EOS from the template, BOS from EOS, padding from the unknown token or EOS."""
    end = eos or stop or "</s>"
    return {"eos": end, "bos": bos or end, "pad": pad or unk or end}


def next_token_accuracy(df: DataFrame, predicted: str, labels: str) -> DataFrame:
    """Share of places where the prediction equals the label one place later, over all rows."""
    pairs = F.arrays_zip(F.slice(F.col(predicted), F.lit(1), F.greatest(F.size(predicted) - 1, F.lit(0))).alias("p"), F.slice(F.col(labels), F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))).alias("l"))
    hit = F.size(F.filter(pairs, lambda x: x["p"] == x["l"]))
    return df.agg((F.sum(hit) / F.sum(F.size(pairs))).alias("accuracy"))


def argmax(scores: Column) -> Column:
    """Place of the first largest score, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def before_stop(df: DataFrame, key: str, pos: str, token: str, stop: str) -> DataFrame:
    """Tokens of a stream before the first that contains the stop word."""
    seen = F.max(F.contains(F.col(token), F.lit(stop)).cast("int")).over(Window.partitionBy(key).orderBy(pos))
    return df.withColumn("_seen", seen).where("_seen = 0").drop("_seen")


def growing_text(df: DataFrame, key: str, pos: str, token: str, stop: str = "") -> DataFrame:
    """The text of a stream after each token, cut at the stop string."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    text = F.array_join(F.collect_list(token).over(w), "")
    return df.withColumn("text", F.substring_index(text, stop, 1) if stop else text)
