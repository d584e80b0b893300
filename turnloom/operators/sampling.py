"""Splits, limits and shuffles that come out the same however the table is partitioned.

The order of a seeded shuffle is that of ``md5(seed:key)``.  Head and tail splits
never number all rows in one task: the row at the border is found by counting.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from turnloom.session import cut


def shuffle_key(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(shuffle_key(key, seed), key)


def unseeded_shuffle(df: DataFrame) -> DataFrame:
    return df.orderBy(F.rand())


def first_n(df: DataFrame, n: int | None, *order: str | Column) -> DataFrame:
    """The first n rows; all for None and for n below 1."""
    return df.orderBy(*order).limit(n) if n and n > 0 else df


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(shuffle_key(key, seed), key).limit(n)


def in_ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """The rows in ranges of an order, as many as the shuffle has partitions: ``_b`` is the range, ``_nth`` the place of a
    row within it.  Written to the checkpoint folder, so that both stay what they are."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return cut(placed).withColumn("_b", F.shiftright("_id", 33)).withColumn("_nth", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def ranked(df: DataFrame, key: str | Column) -> DataFrame:
    """Adds ``place``, the place of each row in the order of a unique key, from 0, without ordering all rows in one task:
    rows are numbered within ranges of the key, and the ranges are added up."""
    rows = in_ranges(df.withColumn("_k", F.col(key) if isinstance(key, str) else key), "_k").drop("_k")
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_b").withColumn("place", (F.col("_nth") + F.col("_before")).cast("bigint")).drop("_b", "_nth", "_before")  # as many rows as there are ranges


#: Keys that may be between two bounds when the border is looked for among them.
FEW = 50_000


def border(df: DataFrame, order: Column, key: str, n: int) -> Row | None:
    """The n-th row (``o, k``) in the order of a number and, where that is the same, of the key; None for n below 1.  It
    is found by counting between bounds that close in on it; only rows between the last bounds are ordered."""
    if n < 1:
        return None
    rows = df.select(order.alias("o"), F.col(key).alias("k"))
    left = n
    while True:
        total = rows.count()
        if total <= FEW:
            break
        share = left / total
        low, high = rows.agg(F.percentile_approx("o", [max(share - 0.005, 0.0), min(share + 0.005, 1.0)], 10_000)).first()[0]
        upto, over = rows.agg(F.count_if(F.col("o") < low), F.count_if(F.col("o") <= high)).first()
        if left <= upto:
            part = rows.where(F.col("o") < low)
        elif left <= over:
            part, left = rows.where(F.col("o").between(low, high)), left - upto
        else:
            part, left = rows.where(F.col("o") > high), left - over
        if part.count() == total:
            break  # one number on all rows
        rows = part
    return rows.orderBy("o", "k").limit(left).agg(F.max(F.struct("o", "k")).alias("x")).first().x


def _split(df: DataFrame, order: Column, key: str, n: int) -> DataFrame:
    at = border(df, order, key, n)
    first = F.lit(False) if at is None else (order < F.lit(at.o)) | (order == F.lit(at.o)) & (F.col(key) <= F.lit(at.k))
    return df.withColumn("split", F.when(first, "validation").otherwise("train"))


def rounded(n: int, percent: float, how: str) -> int:
    exact = n * percent / 100
    return {"nearest": lambda: math.floor(exact + 0.5), "down": lambda: math.floor(exact), "up": lambda: math.ceil(exact)}[how]()


def head_split(df: DataFrame, key: str, percent: float, how: str = "nearest") -> DataFrame:
    """Adds ``split``: the first percentage of the rows by a unique key is for validation, the rest for training.  Rows
    aren't moved: the key at the border is found by counting (text keys are numbered)."""
    n = rounded(df.count(), percent, how)
    if df.schema[key].dataType.typeName() in ("string", "binary"):
        return ranked(df, key).withColumn("split", F.when(F.col("place") < n, "validation").otherwise("train")).drop("place")
    return _split(df, F.col(key), key, n)


def hash_holdout(df: DataFrame, key: str, percent: float, seed: int = 42) -> DataFrame:
    """Adds ``split``: of the seeded shuffle the first percentage, rounded up, is for validation.  The digest at the border
    is found by counting, by the number that its first 15 digits are."""
    digest = shuffle_key(key, seed)
    rows = df.withColumn("_d", F.concat(digest, F.lit(":"), F.col(key).cast("string")))
    out = _split(rows, F.conv(F.substring("_d", 1, 15), 16, 10).cast("bigint"), "_d", rounded(df.count(), percent, "up"))
    return out.drop("_d")


def held_out(df: DataFrame, key: str, percent: float, validation: DataFrame | None = None) -> DataFrame:
    """Adds ``split``.  With rows of their own for validation those follow the training rows; only without any is a
    percentage of the rows held out."""
    if validation is not None and not validation.isEmpty():
        return df.withColumn("split", F.lit("train")).unionByName(validation.withColumn("split", F.lit("validation")), allowMissingColumns=True)
    return head_split(df, key, percent)


def tail_n(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.orderBy(F.desc(key)).limit(n)


def range_select(df: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """Rows at the places from start up to end; all if end isn't positive."""
    return ranked(df, key).where((F.col("place") >= start) & (F.col("place") < end)).drop("place") if end > 0 else df


def drawn_pairs(n: int, left: DataFrame, right: DataFrame, key: str, text: str, seed: int = 42) -> DataFrame:
    """n pairs with replacement: ``id, left_text, right_text``.  Rows are numbered and drawn by number, in two joins."""
    a, b = ranked(left, key).select(F.col("place").alias("l"), F.col(text).alias("left_text")), ranked(right, key).select(F.col("place").alias("r"), F.col(text).alias("right_text"))
    na, nb = left.count(), right.count()
    digest = lambda salt: F.md5(F.concat(F.lit(f"{seed}:{salt}:"), F.col("id").cast("string")).cast("binary"))
    pick = lambda salt, size: F.conv(F.substring(digest(salt), 1, 12), 16, 10).cast("bigint") % max(size, 1)
    ids = left.sparkSession.range(n if na and nb else 0).withColumns({"l": pick("l", na), "r": pick("r", nb)})
    return ids.join(a, "l").join(b, "r").select("id", "left_text", "right_text")


def shuffled_groups(df: DataFrame, key: str, text: str, size: int = 5, seed: int = 42) -> DataFrame:
    """Whole groups of ``size`` rows of the seeded shuffle: ``grp, texts``; rows numbered from 1 within the group.  A group
    is issued only if its last line can be read (isn't null)."""
    rows = ranked(df.withColumn("_s", F.concat(shuffle_key(key, seed), F.lit(":"), F.col(key).cast("string"))), "_s")
    rows = rows.withColumn("grp", F.floor(F.col("place") / size)).withColumn("n", F.col("place") % size + 1)
    line = F.when(F.col(text).isNotNull(), F.concat(F.col("n").cast("string"), F.lit(". "), F.col(text)))
    out = rows.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("n", line.alias("t"))))), lambda x: x["t"]), "\n").alias("texts"), F.max(F.when(F.col(text).isNotNull(), F.col("n"))).alias("last"))
    return out.where(F.col("last") == size).drop("last")


def token_pair_filter(df: DataFrame, chosen: str, rejected: str, most: int) -> DataFrame:
    return df.where(F.size(chosen).between(1, most) & F.size(rejected).between(1, most))


def char_pair_filter(df: DataFrame, prompt: str, chosen: str, rejected: str, most: int) -> DataFrame:
    """By code points of prompt and reply together."""
    return df.where(F.length(F.concat(prompt, chosen)).between(1, most) & F.length(F.concat(prompt, rejected)).between(1, most))


def some_label(df: DataFrame, labels: str = "labels", ignored: int = -100) -> DataFrame:
    """Rows with a label that counts; lists without any fall out."""
    return df.where(F.exists(labels, lambda x: x != ignored))


def nonempty(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.length(column) > 0)


def prompt_length_filter(df: DataFrame, messages: str, prompt: str, length: str, most: int) -> DataFrame:
    """At least two messages, a prompt, and no more than ``most`` in it."""
    return df.where((F.size(messages) >= 2) & (F.length(prompt) > 0) & (F.col(length) <= most))


def batch_number(df: DataFrame, key: str, size: int) -> DataFrame:
    return ranked(df, key).withColumn("batch", F.floor(F.col("place") / size)).drop("place")


def sharded(df: DataFrame, n: int, key: str) -> DataFrame:
    """Adds ``shard`` (0 to n - 1) and lays each shard in one partition or more.  Every row is in exactly one shard."""
    return df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).repartition(n, "shard")
