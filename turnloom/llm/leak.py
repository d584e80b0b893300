"""Which records contain passages of held-out items.

Winnowing: the hash of every k-gram is taken, and of each window of w
neighbouring k-grams the smallest (the rightmost, in a tie) is kept.  Texts
that share a span of at least k + w - 1 units share a whole window, and so a
kept hash: every sufficiently long span is found.  The kept hashes of the
corpus are joined with those of the items, and each hit is extended in both
directions to its full run, which must reach the required length.

Units are words (runs of letters and digits) for items in a spaced language,
and letters and digits one by one for Chinese items; case, punctuation and
white space don't count.  Null and short texts have no hits.  An item given
twice, or a record given twice, counts once.  Whole texts are read; there is no
limit on hits, on the length of a text or on the number of items: items are
taken in blocks of bounded size, each of which passes over the corpus once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.batches import text_chunks
from turnloom.session import map_batches

#: (k, w) of the winnowing by unit; spans of k + w - 1 units are guaranteed.
WORDS, CHARS = (5, 6), (9, 10)
#: Bytes of item text in a block; a block and its hashes are sent to every executor.
BLOCK_BYTES = 32 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point to its lower-case letter or digit, 0 for everything else."""
    t = np.zeros(0x110000, np.uint32)
    for cp in range(0x20000):
        ch = chr(cp)
        if ch.isalnum():
            t[cp] = ord(ch.lower()[0])
    t[0x20000:0x323B0] = np.arange(0x20000, 0x323B0)
    return t


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after another as folded code points, 0 between them, and the text of each place."""
    texts = [t or "" for t in texts]
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(codes)]
    return fold_table()[codes], owner


def char_units(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = codes > 0
    return codes[keep].astype(np.uint64), owner[keep]


def word_units(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word."""
    inside = codes > 0
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = np.cumsum(inside & ~before) - 1
    place = np.flatnonzero(inside)
    nth = place - starts[word[place]]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(nth.max()), _ODD)]), dtype=np.uint64)
        terms = codes[place].astype(np.uint64) * power[nth]
        first = np.searchsorted(place, starts)
        return mixed(np.add.reduceat(terms, first)), owner[starts]


def winnow(units: np.ndarray, owner: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the kept k-grams."""
    n = len(units) - (k + w - 1) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        grams = np.zeros(len(units) - k + 1, np.uint64)
        for j in range(k):
            grams = grams * _ODD + units[j : j + len(grams)]
        grams = mixed(grams)
    best, where = grams[:n].copy(), np.arange(n)
    for j in range(1, w):
        later = grams[j : j + n]
        better = later <= best
        best = np.where(better, later, best)
        where[better] = np.flatnonzero(better) + j
    whole = owner[:n] == owner[k + w - 2 : k + w - 2 + n]
    kept = where[whole]  # in order already
    kept = kept[np.concatenate([[True], kept[1:] != kept[:-1]])] if len(kept) else kept
    return kept, grams[kept]


class ItemIndex:
    """The items of a block: their units and the sorted hashes of their kept k-grams, by kind of unit."""

    def __init__(self, rows: list[tuple[int, str, str]]):
        self.kinds = []
        for split, (k, w), chosen in (
            (word_units, WORDS, [r for r in rows if r[1] != "zh"]),
            (char_units, CHARS, [r for r in rows if r[1] == "zh"]),
        ):
            units, owner = split(*folded([r[2] for r in chosen]))
            kept, hashes = winnow(units, owner, k, w)
            order = np.argsort(hashes, kind="stable")
            starts = np.searchsorted(owner, np.arange(len(chosen)))
            ends = np.searchsorted(owner, np.arange(len(chosen)), side="right")
            self.kinds.append((split, k, w, np.array([r[0] for r in chosen], np.int64), units, owner, starts, ends, hashes[order], kept[order]))

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(place of the text, item id), each pair once."""
        out: set[tuple[int, int]] = set()
        codes, of = folded(texts)
        for split, k, w, ids, items, item_of, starts, ends, hashes, places in self.kinds:
            if not len(hashes):
                continue
            units, owner = split(codes, of)
            kept, own = winnow(units, owner, k, w)
            low, high = np.searchsorted(hashes, own), np.searchsorted(hashes, own, side="right")
            some = np.flatnonzero(high > low)
            count = (high - low)[some]
            p = np.repeat(kept[some], count)
            q = places[np.repeat(low[some] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())] if len(some) else np.zeros(0, np.int64)
            # one look at each run: hits of one text and item on the same diagonal lie in few runs
            done: dict[tuple[int, int, int], int] = {}
            text_start = np.searchsorted(owner, np.arange(len(texts)))
            text_end = np.searchsorted(owner, np.arange(len(texts)), side="right")
            for a, b in zip(p.tolist(), q.tolist(), strict=True):
                t, i = int(owner[a]), int(item_of[b])
                if (t, int(ids[i])) in out or done.get((t, i, a - b), -1) >= a:
                    continue
                back = min(a - int(text_start[t]), b - int(starts[i]))
                ahead = min(int(text_end[t]) - a, int(ends[i]) - b)
                same = units[a - back : a + ahead] == items[b - back : b + ahead]
                wrong = np.flatnonzero(~same)
                at = int(np.searchsorted(wrong, back))
                first = int(wrong[at - 1]) + 1 if at else 0
                last = int(wrong[at]) if at < len(wrong) else back + ahead
                done[t, i, a - b] = a - back + last - 1
                if last - first >= k + w - 1 and first <= back < last:
                    out.add((t, int(ids[i])))
        found = np.array(sorted(out), np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]


def item_blocks(items: DataFrame, item: str, lang: str, text: str, size: int = BLOCK_BYTES) -> Iterator[ItemIndex]:
    """The items in blocks of about ``size`` bytes of text, so that a test set of any size can be used."""
    rows = items.select(F.col(item).alias("i"), F.col(lang).alias("l"), F.col(text).alias("t")).where("i is not null and t is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = total // size + 1
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield ItemIndex([(r.i, r.l, r.t) for r in part.collect()])


def leaked_items(records: DataFrame, items: DataFrame, key: str, text: str, item: str = "item_id", lang: str = "lang", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``key`` and ``item_id`` of every record that contains a passage of the item."""
    kind = records.schema[key].dataType.simpleString()
    source, out = records.select(records[key], records[text]).where(F.col(key).isNotNull()), None
    for index in item_blocks(items, item, lang, item_text, block_bytes):
        shared = records.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for chunk in text_chunks(batches, 1):
                t, i = shared.value.hits(chunk.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([chunk.column(0).take(pa.array(t)), pa.array(i)], names=[key, item])

        part = map_batches(source, run, f"`{key}` {kind}, `{item}` bigint")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
