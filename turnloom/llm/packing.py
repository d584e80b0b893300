"""Documents into containers of a fixed capacity.

Hierarchical packing with windows of several context sizes.  Sizes are token
counts under a public tokenizer.  A document goes to the shortest window that
holds it; every window of the longer tiers is opened by one of its own
documents and its gap filled with the largest documents of the shorter tiers
that fit; the shortest tier is packed in the same way among its own.  Windows
are powers of two, so laid one after another, longest tier first, none crosses
the border of a container.  Containers are dealt to steps in turn: along the
line tiers and window loads only fall, so every step gets the same mixture.

The plan depends on nothing but the histogram of sizes, which has at most as
many rows as the capacity has tokens, whatever the number of documents: it is
made on the driver in bulk (so many windows of this pattern) and sent to the
executors as intervals of ranks.  A document finds its place by its rank among
those of its size; ranks are counted in buckets, so one size may hold all rows.

Defined results: a document longer than the capacity is cut into pieces of
the capacity and one rest, and no other is split; null, empty and zero-length
documents take no space: they have one piece of 0 tokens at offset 0 of some
container.  Rows with the same key are documents of their own.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.batches import text_chunks
from turnloom.llm.encode import SPLIT_PATTERN, TOKENIZER_DIR, ranks_of, vocabulary
from turnloom.session import cut, map_batches

#: Windows, shortest first; the last is the capacity of a container.
TIERS = (1024, 2048, 4096, 8192)
#: Containers of a step.
STEP = 16
#: Rows of one size that are ranked in one bucket, about.
BUCKET_ROWS = 1_000_000


@lru_cache(maxsize=2)
def _tokenizer(content: bytes):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks_of(content), special_tokens={})


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``key`` and ``size``: the number of tokens, 0 for null and empty texts."""
    kind = docs.schema[key].dataType.simpleString()
    content = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(content.value).encode_ordinary
        for chunk in text_chunks(batches, 1):
            sizes = [len(encode(t)) if t else 0 for t in chunk.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(sizes, pa.int64())], names=[key, "size"])

    return map_batches(docs.select(docs[key], docs[text]), run, f"`{key}` {kind}, size bigint")


class Plan:
    """Where the items of each size go: sorted intervals of ranks.

    An interval holds ranks ``[rank, rank + windows * times)`` of one size; the item of rank r lies in the window
    ``(r - rank) // times`` of the interval, at ``base + window * width + inner + ((r - rank) % times) * size``."""

    def __init__(self, histogram: dict[int, int], tiers: tuple[int, ...] = TIERS):
        if list(tiers) != sorted(set(tiers)) or any(tiers[-1] % w for w in tiers) or any(b % a for a, b in zip(tiers, tiers[1:], strict=False)):
            raise ValueError("tiers must rise, each a multiple of the one before")
        left = {s: n for s, n in histogram.items() if s > 0 and n > 0}
        if left and max(left) > tiers[-1]:
            raise ValueError("a size exceeds the capacity")
        self.tiers, self.capacity, self.used = tiers, tiers[-1], sum(s * n for s, n in left.items())
        sizes = sorted(left)
        given = dict.fromkeys(sizes, 0)  # ranks already placed
        rows: list[tuple[int, ...]] = []
        line = 0
        for t in range(len(tiers) - 1, -1, -1):
            width, least = tiers[t], tiers[t - 1] if t else 0
            while sizes and sizes[-1] > least:
                pattern = self._pattern(sizes, left, width)
                windows = min(left[s] // n for s, n in pattern)
                inner = 0
                for s, n in pattern:
                    rows.append((s, given[s], line, width, n, inner))
                    given[s] += n * windows
                    left[s] -= n * windows
                    inner += n * s
                    if not left[s]:
                        sizes.remove(s)
                line += width * windows
        self.containers = -(-line // self.capacity)
        rows.sort()
        self.table = np.array(rows, np.int64).reshape(-1, 6)
        self.keys = self.table[:, 0] << 44 | self.table[:, 1]

    @staticmethod
    def _pattern(sizes: list[int], left: dict[int, int], width: int) -> list[tuple[int, int]]:
        """The largest size, then each time the largest that still fits, as often as it fits and there are any."""
        out, gap, at = [], width, len(sizes) - 1
        while at >= 0:
            s = sizes[at]
            n = min(gap // s, left[s])
            out.append((s, n))
            gap -= n * s
            at = min(at, bisect_right(sizes, gap)) - 1
        return out

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place on the line, window width) of items by size and rank."""
        row = self.table[np.searchsorted(self.keys, size << 44 | rank, side="right") - 1]
        nth = rank - row[:, 1]
        return row[:, 2] + nth // row[:, 4] * row[:, 3] + row[:, 5] + nth % row[:, 4] * size, row[:, 3]


_OUT = "piece bigint, start bigint, size bigint, width bigint, container_id bigint, offset bigint, step bigint"


def pack(sized: DataFrame, key: str = "doc_id", tiers: tuple[int, ...] = TIERS, step: int = STEP) -> DataFrame:
    """From ``key`` and ``size``: for every piece of every document its number, its first token in the document, its
    size, the width of its window, its container, its offset in the container, and the step of the container."""
    capacity, kind = tiers[-1], sized.schema[key].dataType.simpleString()
    size = F.coalesce("size", F.lit(0))
    many = F.greatest(F.lit(1), F.ceil(size / capacity)).cast("bigint")
    pieces = sized.select(key, size.alias("whole"), F.explode(F.sequence(F.lit(0).cast("bigint"), many - 1)).alias("piece"))
    pieces = pieces.withColumn("start", F.col("piece") * capacity).withColumn("size", F.least(F.lit(capacity), F.col("whole") - F.col("start")))
    items = cut(pieces.select(key, "piece", "start", "size"))
    counts = items.groupBy("size").agg(F.count("*").alias("n")).collect()  # one row for each size up to the capacity
    plan = Plan({r["size"]: r.n for r in counts}, tiers)
    buckets = 1 + sum(r.n for r in counts) // BUCKET_ROWS
    steps = max(1, -(-plan.containers // step))
    items = items.withColumn("bucket", F.pmod(F.xxhash64(F.col(key), F.col("piece")), F.lit(buckets)))
    nth = F.row_number().over(Window.partitionBy("size", "bucket").orderBy(key, "piece")) - 1
    before = F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    if buckets == 1:
        ranked = items.withColumn("rank", nth.cast("bigint"))
    else:
        offsets = items.groupBy("size", "bucket").agg(F.count("*").alias("n")).select("size", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
        ranked = items.withColumn("nth", nth).join(offsets, ["size", "bucket"]).withColumn("rank", (F.col("nth") + F.col("before")).cast("bigint"))
    shared = sized.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            n, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            line, width = np.zeros(len(n), np.int64), np.full(len(n), p.tiers[0], np.int64)
            if (n > 0).any():
                line[n > 0], width[n > 0] = p.place(n[n > 0], rank[n > 0])
            if p.containers:
                line[n == 0] = rank[n == 0] % p.containers * p.capacity
            at = line // p.capacity
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(x) for x in (width, at, line % p.capacity, at % steps))], names=[key, "piece", "start", "size", "width", "container_id", "offset", "step"])

    return map_batches(ranked.select(key, "piece", "start", "size", "rank"), run, f"`{key}` {kind}, {_OUT}")


def container_report(packed: DataFrame, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """``container_id``, ``step``, ``pieces``, ``used`` and ``unused`` tokens of every container."""
    rows = packed.groupBy("container_id", "step").agg(F.count("*").alias("pieces"), F.sum("size").alias("used"))
    return rows.withColumn("unused", F.lit(tiers[-1]) - F.col("used"))
