"""Whether a text that has no final stop ends with a whole sentence.

A sentence that breaks off ends with units (words, or characters of a wide
script) after which the sentences of the corpus go on; a whole one ends with
units after which they stop.  So the corpus is asked how often the last one,
two ... ``DEEP`` units of the text occur in its sentences, and how often right
before a stop.  The shares are interpolated from the shortest to the longest
context, so a context counts as much as it has been seen; for a last unit that
no sentence has, the place it stands in (the units before it, whatever follows)
answers first.  A word that is hardly ever seen whole but often as the beginning
of longer ones is cut.  A reply of a single sentence which starts or goes on
like no sentence of the corpus is a short answer, not a broken sentence.

The counts cover all replies.  They are made in two steps, so that little is
shuffled: the contexts in question are gathered first and sent to all tasks as a
bit set of bounded size (``BITS``); a task counts the contexts that the set has,
and the exact ones are joined afterwards, so the size of the set changes the
shuffle but no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.batches import text_chunks
from turnloom.llm.langid import BREAK, LETTER, MARK, SPACE, WIDE, tables
from turnloom.llm.leak import mixed
from turnloom.session import cut, map_batches

#: Units of the longest context, and of the longest one before an unknown unit.
DEEP, BEFORE = 6, 3
#: Units of the beginning of a clause.
FRAME = 4
#: Units of a short reply whose neighbours are compared with those of the corpus.
NEAR = 8
#: How much a shorter context weighs, in sightings of the longer one.
WEIGHT = 4.0
#: A share of stops below this makes a sentence broken.
BROKEN = 0.06
#: Words of 64 bits in the set of contexts, at most: 16 MB.
BITS = 1 << 21
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
#: What a count is about: contexts, contexts before an unknown unit, starts of sentences, beginnings of words.
_EXACT, _PLACE, _START, _PART = (_U(k) for k in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B, 0x510E527FADE682D1))

#: Classes of code points here.
_NONE, _WORD, _WIDE, _DIGIT, _INNER, _COMMA, _STOP, _DOT, _TEXT = range(9)
_MARKER = re.compile(r"(?m)(?:^|(?<=\x00))[^\S\n]*(?:[-*•]|\(?\d{1,3}[.)、）](?!\d))")


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind, low, _ = tables()
    own = np.zeros(len(kind), np.uint8)
    own[(kind == LETTER) | (kind == MARK)] = _WORD
    own[kind == WIDE] = _WIDE
    for cp in range(0x10000):
        if chr(cp).isdigit():
            own[cp] = _DIGIT
    for cls, chars in ((_INNER, "'’"), (_COMMA, "，,；;：:、"), (_STOP, "。！？!?｡\n"), (_DOT, "."), (_TEXT, "\0")):
        for ch in chars:
            own[ord(ch)] = cls
    return own, low


def _shift(a: np.ndarray, by: int, fill: int = 0) -> np.ndarray:
    """The value ``by`` places before each place (after it, if negative)."""
    out = np.full_like(a, fill)
    if by > 0:
        out[by:] = a[:-by]
    else:
        out[:by] = a[-by:]
    return out


class Units:
    """The units of a list of texts, one after another.

    ``hash`` of the unit; ``nth`` in its clause and in its sentence; ``stops``: whether a stop comes next; ``closed``:
    whether its sentence has a stop; ``text``; ``word``: whether it is a word, with ``part`` and ``part_of``: the
    hashes of the proper beginnings of words and their units."""

    def __init__(self, texts: list[str]):
        own, low = _classes()
        joined = _MARKER.sub("", "\0".join(t.replace("\0", " ") for t in texts) + "\0")
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = own[codes]
        after, before = _shift(kind, -1, _TEXT), _shift(kind, 1, _TEXT)
        space = tables()[0][_shift(codes, -1, 0)]
        kind = np.where((kind == _DOT) & ((after == _TEXT) | (after == _STOP) | (space == SPACE) | (space == BREAK)), _STOP, kind)
        word = (kind == _WORD) | (kind == _INNER) & (before == _WORD) & (after == _WORD)
        first = word & ~_shift(word, 1, False)
        digit = (kind == _DIGIT) & (before != _DIGIT)
        at = np.flatnonzero(first | digit | (kind == _WIDE))
        stop = np.flatnonzero((kind == _STOP) | (kind == _TEXT))
        edge = np.flatnonzero((kind == _STOP) | (kind == _TEXT) | (kind == _COMMA))
        sentence, clause = np.searchsorted(stop, at), np.searchsorted(edge, at)
        if len(at):  # a number that is a sentence by itself is the mark of a list
            alone = digit[at] & (sentence != _shift(sentence, 1, -1)) & (sentence != _shift(sentence, -1, -1))
            at, sentence, clause = at[~alone], sentence[~alone], clause[~alone]
        n = len(at)
        self.text = np.searchsorted(np.flatnonzero(kind == _TEXT), at)
        self.word = first[at]
        self.sentence, self.clause = sentence, clause
        self.closed = kind[stop[sentence]] == _STOP
        place = np.arange(n)
        new = np.ones(n, bool)
        new[1:] = clause[1:] != clause[:-1]
        self.nth = place - np.maximum.accumulate(np.where(new, place, 0)) if n else place
        fresh = np.ones(n, bool)
        fresh[1:] = sentence[1:] != sentence[:-1]
        self.in_sentence = place - np.maximum.accumulate(np.where(fresh, place, 0)) if n else place
        last = np.ones(n, bool)
        last[:-1] = clause[1:] != clause[:-1]
        self.stops = last & (kind[edge[clause]] == _STOP)
        # hashes: the sum over the characters of a word, each with its place
        inside = np.cumsum(first | digit | (kind == _WIDE)) - 1
        starts = np.flatnonzero(first | digit | (kind == _WIDE))
        self.part = self.part_of = np.zeros(0, _U)
        self.hash = np.zeros(0, _U)
        if not len(starts):
            return
        offset = np.where(inside >= 0, np.arange(len(codes)) - starts[np.maximum(inside, 0)], 0)
        with np.errstate(over="ignore"):
            each = mixed(low[codes].astype(_U) + (offset.astype(_U) << _U(24)) + _U(1))
            each = np.where(word | (kind == _WIDE), each, _U(0))
            each[digit] = _U(0xD1617)
            upto = np.cumsum(each, dtype=_U)
            whole = np.add.reduceat(each, starts)
            self.hash = mixed(whole[inside[at]])
            go_on = word & _shift(word, -1, False)  # a proper beginning ends here
            begun = upto - (upto[starts] - each[starts])[np.maximum(inside, 0)]
            self.part, part_at = mixed(begun[go_on]), inside[go_on]
        kept = np.full(len(starts), -1, np.int64)
        kept[inside[at]] = place
        self.part_of = kept[part_at]
        self.part, self.part_of = self.part[self.part_of >= 0], self.part_of[self.part_of >= 0]

    def contexts(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of the contexts that end with each unit, from one unit to ``DEEP``, and of those before it, from one to
        ``BEFORE``; 0 where the clause has fewer units."""
        exact, place, h = [], [], np.zeros(len(self.hash), _U)
        with np.errstate(over="ignore"):
            power = _U(1)
            for k in range(max(DEEP, BEFORE + 1)):
                h = h + _shift(self.hash, k, 0) * power if k else self.hash.copy()
                power = power * _ODD
                enough = self.nth >= k
                if k < DEEP:
                    exact.append(np.where(enough, mixed(h + _EXACT + _U(k)) | _U(1), _U(0)))
                if 0 < k <= BEFORE:
                    place.append(np.where(enough, mixed(h - self.hash + _PLACE + _U(k)) | _U(1), _U(0)))
        return exact, place

    def framed(self, exact: list[np.ndarray]) -> np.ndarray:
        """Ids of the first ``FRAME`` units of the clause together with each unit after them; 0 for the first ones."""
        out = np.zeros(len(self.hash), _U)
        at = np.flatnonzero(self.nth >= FRAME)
        with np.errstate(over="ignore"):
            out[at] = mixed(exact[FRAME - 1][at - self.nth[at] + FRAME - 1] + self.hash[at] * _ODD) | _U(1)
        return out

    def starts(self) -> list[np.ndarray]:
        """Ids of the first unit of a sentence, of its first two, and of the second whatever the first is, each at the
        last of its units; 0 elsewhere."""
        out = [np.zeros(len(self.hash), _U) for _ in range(3)]
        one, two = np.flatnonzero(self.in_sentence == 0), np.flatnonzero(self.in_sentence == 1)
        with np.errstate(over="ignore"):
            out[0][one] = mixed(self.hash[one] + _START) | _U(1)
            second = self.hash[two] + _START + (self.nth[two] == 0).astype(_U) * _U(4)
            out[1][two] = mixed(second + self.hash[two - 1] * _ODD + _U(1)) | _U(1)
            out[2][two] = mixed(second + _U(2)) | _U(1)
        return out

    def brief(self) -> np.ndarray:
        """Whether the sentence of each unit has ``NEAR`` units at most."""
        size = np.bincount(self.sentence) if len(self.sentence) else np.zeros(0, np.int64)
        return size[self.sentence] <= NEAR


def part_ids(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(hashes + _PART) | _U(1)


#: Places of a question: contexts, contexts before, beginning of a word, frame, starts (one unit, two units, the second), the
#: first unit and the first two anywhere, all units, then ``NEAR`` single units and their pairs anywhere.
_AT_PLACE = DEEP
_AT_PART = DEEP + BEFORE
_AT_FRAME = _AT_PART + 1
_AT_START = _AT_FRAME + 1
_AT_FIRST = _AT_START + 3
_AT_ALL = _AT_FIRST + 2
_AT_NEAR = _AT_ALL + 1
#: The id of all units.
_ALL = 1


def questions(texts: list[str]) -> list[list[int] | None]:
    """What the corpus is to be asked about the end of each text: ids by place; None where a text has nothing to ask."""
    u = Units(texts)
    out: list[list[int] | None] = [None] * len(texts)
    if not len(u.hash):
        return out
    exact, place = u.contexts()
    frame = u.framed(exact)
    one, two, second = u.starts()
    last = np.flatnonzero(np.append(u.text[1:] != u.text[:-1], True))
    begin = np.append(0, last[:-1] + 1)
    for a, z in zip(begin.tolist(), last.tolist(), strict=True):
        if u.closed[z]:
            continue
        ids = [int(x[z]) for x in exact] + [int(x[z]) for x in place] + [int(part_ids(u.hash[z : z + 1])[0]) if u.word[z] else 0, int(frame[z])]
        if u.sentence[a] == u.sentence[z]:  # the whole reply
            ids += [int(one[a]), int(two[a + 1]) if z > a else 0, int(second[a + 1]) if z > a else 0]
            ids += [int(exact[0][a]), int(exact[1][a + 1]) if z > a else 0, _ALL]
            near = np.arange(max(a, z - NEAR + 1), z + 1)
            pad = [0] * (NEAR - len(near))
            ids += pad + exact[0][near].tolist() + pad + exact[1][near].tolist()
        out[u.text[z]] = ids
    return out


def whole(ids: list[int], known: dict[int, tuple[int, int]]) -> bool:
    """The answer to a question, from the counts (sightings, stops) of its ids."""
    n = lambda k: known.get(ids[k], (0, 0)) if k < len(ids) and ids[k] else (0, 0)
    seen = n(0)[0]
    if ids[_AT_PART] and 20 * seen < n(_AT_PART)[0]:
        return False  # the beginning of a word
    if len(ids) > _AT_NEAR:  # all of the reply
        starts, first, total = n(_AT_START)[0], n(_AT_FIRST)[0], max(n(_AT_ALL)[0], 1)
        if not seen or starts < 0.01 * first:
            return True  # a last word of its own, or a first one that no sentence begins with
        begun, brief = n(_AT_START + 1) if starts else n(_AT_START + 2)
        if 5 * brief > begun or starts + begun < 3 and not first:
            return True  # what begins like this is brief, or unknown
        if not begun and starts * n(_AT_FIRST + 1)[0] >= 8 * first:
            return True  # as often as the two units are seen, some sentence would begin with them
        for k in range(_AT_NEAR + 1, _AT_NEAR + NEAR):
            expected = n(k - 1)[0] * n(k)[0] / total
            if ids[k + NEAR] and expected >= 20 and 50 * n(k + NEAR)[0] < expected:
                return True  # units in an order that sentences don't have
    seen, stops = n(_AT_FRAME)
    if seen >= 5 and stops >= 0.95 * seen:
        return True  # in such a clause nothing ever follows this unit
    share = 0.3
    for k in (*range(_AT_PLACE, _AT_PART), *range(DEEP)):
        m, stops = n(k)
        share = (stops + WEIGHT * share) / (m + WEIGHT)
    return share >= BROKEN


class Counter64:
    """Sightings and stops by id."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, ids: np.ndarray, stops: np.ndarray) -> None:
        order = np.argsort(ids)
        ids, stops = ids[order], stops[order]
        if len(ids):
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            self._keep(ids[first], np.diff(np.append(first, len(ids))), np.add.reduceat(stops.astype(np.int64), first))

    def _keep(self, *part: np.ndarray) -> None:
        self.parts.append(part)
        self.held += len(part[0])
        if self.held > 2_000_000 and len(self.parts) > 1:
            self.compact()

    def compact(self) -> None:
        ids, n, stops = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        order = np.argsort(ids)
        ids, n, stops = ids[order], n[order], stops[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        self.parts = [(ids[first], np.add.reduceat(n, first), np.add.reduceat(stops, first))]
        self.held = len(first)

    def batch(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.compact()
            ids, n, stops = self.parts[0]
            for at in range(0, len(ids), 100_000):
                cols = (ids[at : at + 100_000].view(np.int64), n[at : at + 100_000], stops[at : at + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "n", "stops"])


def count(texts: list[str], into: Counter64, wanted: np.ndarray | None = None) -> None:
    """Counts the contexts of all sentences that end with a stop, and how often they are right before it (of starts: in
    brief sentences); ``wanted``: a bit set of ids, all if None."""
    u = Units(texts)
    keep = np.flatnonzero(u.closed)
    if not len(keep):
        return
    exact, place = u.contexts()
    closed = u.closed[u.part_of] if len(u.part_of) else np.zeros(0, bool)
    every = [(x[keep], u.stops[keep]) for x in (*exact, *place, u.framed(exact))] + [(x[keep], u.brief()[keep]) for x in u.starts()]
    every.append((np.full(len(keep), _ALL, _U), np.zeros(len(keep), bool)))
    every.append((part_ids(u.part[closed]), np.zeros(int(closed.sum()), bool)))
    ids_of, stops_of = [], []
    for ids, stops in every:
        use = ids != 0
        if wanted is not None:
            word = (ids >> _U(6)) & _U(len(wanted) - 1)
            use &= (wanted[word.astype(np.int64)] >> (ids & _U(63)) & _U(1)) != 0
        ids_of.append(ids[use])
        stops_of.append(stops[use])
    into.add(np.concatenate(ids_of), np.concatenate(stops_of))


def asked_bits(asked: DataFrame) -> np.ndarray:
    """The bit set of a column ``id``: at most ``BITS`` words reach the driver, whatever the number of ids."""
    total = asked.agg(F.approx_count_distinct("id")).first()[0]
    words = 1 << 10
    while words < BITS and words * 4 < total:
        words *= 2
    word = F.shiftrightunsigned("id", 6).bitwiseAND(F.lit(words - 1))
    bit = F.expr("shiftleft(1L, cast(id & 63 AS int))")
    rows = asked.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(_U)


def context_counts(replies: DataFrame, text: str, asked: DataFrame) -> DataFrame:
    """``id``, ``n`` and ``stops``, over all rows of ``replies``; the ids of ``asked`` and a few more."""
    wanted = replies.sparkSession.sparkContext.broadcast(asked_bits(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter64()
        for chunk in text_chunks(batches, 0, size=1 << 20):
            count([t for t in chunk.column(0).to_pylist() if t], counts, wanted.value)
        yield from counts.batch()

    return map_batches(replies.select(text), run, "id bigint, n bigint, stops bigint").groupBy("id").agg(F.sum("n").alias("n"), F.sum("stops").alias("stops"))


def answered(found: DataFrame, replies: DataFrame, text: str) -> DataFrame:
    """``found`` has a column ``question`` (ids by place, or null); the same rows with ``whole`` instead, null where
    nothing was asked."""
    found = cut(found.withColumn("q", F.xxhash64("question")))
    asked = found.where("question is not null").select("q", "question").dropDuplicates(["q"])
    each = cut(asked.select("q", F.explode(F.array_distinct("question")).alias("id")).where(~F.col("id").isin(0, _ALL)))
    every = each.sparkSession.range(_ALL, _ALL + 1).select("id")
    counts = cut(context_counts(replies, text, each.select("id").unionByName(every)))
    total = counts.where(F.col("id") == _ALL).select("n").first()  # of all questions the same
    facts = each.join(counts, "id").groupBy("q").agg(F.collect_list(F.struct("id", "n", "stops")).alias("facts"))
    said = map_batches(asked.join(facts, "q", "left"), partial(_answers, total=total.n if total else 0), "q bigint, whole boolean")
    return found.drop("question").join(said, "q", "left").drop("q")


def _answers(batches: Iterator[pa.RecordBatch], total: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, facts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        said = [whole(i, {_ALL: (total, 0)} | {f["id"]: (f["n"], f["stops"]) for f in known or ()}) for i, known in zip(ids, facts, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.bool_())], names=["q", "whole"])
