"""Encoding of text with a public byte-level BPE vocabulary.

The encoder never runs the merge loop.  Every vocabulary entry is put, byte by
byte as Latin-1 characters, into an Aho-Corasick automaton; a greedy
longest-match segmentation comes out of the automaton in C.  A segmentation is
the BPE result exactly when every pair of neighbouring tokens is *compatible*
(the two tokens next to each other encode to themselves), so the pairs of a
whole batch are checked against a memo.  Pieces with an incompatible pair are
redone by backtracking from the longest matches, where every byte position is
left at most once: linear time, and the same ids as the merge loop gives.

Defined results: a null text and an empty text both give an empty list of ids.
Texts of any length are encoded whole.  Columns other than the key and the
text are not read, so clashing names do no harm.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from turnloom.llm.batches import text_chunks
from turnloom.session import map_batches

#: Where the vocabulary files are; a parameter of every function that needs one.
TOKENIZER_DIR = "/opt/tokenizers"

#: Fixed value of the public vocabulary: the pre-tokenizer of byte-level BPE.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A character above Latin-1: no vocabulary entry matches across it.
_GAP = "Ā"
#: The memos are caches: when full they start anew, results never depend on them.
_MEMO_PIECES = 200_000
_MEMO_PAIRS = 4_000_000


class BpeEncoder:
    """Exact byte-level BPE by automaton and compatibility of neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick
        import regex

        self.find = regex.compile(SPLIT_PATTERN).findall
        self.size = len(ranks)
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.rank = ranks
        self.length = [len(t) for t in self.token]
        self.longest = max(self.length, default=1)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.split: list[tuple[int, int]] = [(i, i) for i in range(len(self.token))]
        self.merged: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self._forget()
        self.shorter: dict[int, int] = {}
        self._learn_splits()

    def _learn_splits(self) -> None:
        """The last merge of every token.  In order of rank the halves are known before the whole."""
        rank, split, merged, compatible = self.rank, self.split, self.merged, self._compatible
        for r in range(len(self.token)):
            token = self.token[r]
            for cut in range(1, len(token)):
                a = rank.get(token[:cut])
                if a is None or a >= r:
                    continue
                b = rank.get(token[cut:])
                if b is None or b >= r or not compatible(a, b):
                    continue
                split[r] = (a, b)
                merged[a << 32 | b] = r
                break

    def _compatible(self, left: int, right: int) -> bool:
        """Whether BPE keeps the border between two tokens: undo the merges next to it, latest first, and see
        whether an earlier merge would have crossed the border."""
        split, merged = self.split, self.merged
        bound = 1 << 62
        while True:
            across = merged.get(left << 32 | right)
            if across is not None and across < bound:
                return False
            if left > right:
                inner = split[left][1]
                if inner != left:
                    bound, left = left, inner
                    continue
                inner = split[right][0]
                if inner == right:
                    return True
                bound, right = right + 1, inner
            else:
                inner = split[right][0]
                if inner != right:
                    bound, right = right + 1, inner
                    continue
                inner = split[left][1]
                if inner == left:
                    return True
                bound, left = left, inner

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= _MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _next_shorter(self, token: int) -> int:
        """The longest vocabulary entry that is a proper prefix of the token, -1 if none."""
        known = self.shorter.get(token)
        if known is None:
            text, rank, known = self.token[token], self.rank, -1
            for n in range(len(text) - 1, 0, -1):
                if (r := rank.get(text[:n])) is not None:
                    known = r
                    break
            self.shorter[token] = known
        return known

    def _longest_at(self, text: str, at: int) -> int:
        value = -1
        n = self.automaton.longest_prefix(text[at : at + self.longest])
        rank, raw = self.rank, text[at : at + n].encode("latin-1")
        while n:
            value = rank.get(raw[:n], -1)
            if value >= 0:
                return value
            n -= 1
        return value

    def backtrack(self, text: str) -> list[int]:
        """Ids of one piece (bytes as Latin-1): longest matches first, shorter ones where neighbours disagree."""
        out: list[int] = []
        end, at, alive = len(text), 0, bytearray(b"\1" * (len(text) + 1))
        token = self._longest_at(text, 0)
        while at < end:
            stop = at + self.length[token]
            if alive[stop] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = stop
                token = self._longest_at(text, at) if at < end else -1
                continue
            token = self._next_shorter(token)
            while token < 0:
                alive[at] = 0
                token = out.pop()
                at -= self.length[token]
                token = self._next_shorter(token)
        return out

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.used = 0

    def _store(self, pieces: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        n, first = len(ids), len(self.place)
        if self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(n, self.used), np.int32)])
        if first + len(pieces) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts[: first + 1], np.zeros(max(len(pieces), first) + 1, np.int64)])
        self.ids[self.used : self.used + n] = ids
        self.starts[first + 1 : first + 1 + len(pieces)] = self.used + np.cumsum(lengths)
        self.used += n
        self.place.update(zip(pieces, range(first, first + len(pieces)), strict=True))

    def _encode_pieces(self, pieces: list[str]) -> None:
        """Puts the ids of pieces into the memo."""
        raw = [p.encode("utf-8").decode("latin-1") for p in pieces]
        flat = np.fromiter(chain.from_iterable(self.automaton.iter_long(_GAP.join(raw))), np.int64).reshape(-1, 2)
        ends, ids = flat[:, 0], flat[:, 1]
        last = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 2  # place of each piece's last byte
        bounds = np.searchsorted(ends, last, side="right")
        keys = ids[:-1] << 32 | ids[1:]
        inside = np.ones(len(keys), bool)
        inside[bounds[:-1] - 1] = False
        unique, where = np.unique(keys[inside], return_inverse=True)
        memo, slow = self.pairs, self._compatible
        if len(memo) + len(unique) > _MEMO_PAIRS:
            memo.clear()
        bad = np.zeros(len(unique), bool)
        for k, key in enumerate(unique.tolist()):
            known = memo.get(key)
            if known is None:
                known = memo[key] = slow(key >> 32, key & 0xFFFFFFFF)
            if not known:
                bad[k] = True
        lengths = np.diff(bounds, prepend=0)
        again = np.unique(np.searchsorted(bounds, np.flatnonzero(inside)[bad[where]], side="right")).tolist()
        if again:
            ids, done, out = ids.astype(np.int32), 0, []
            for k in again:
                redone = self.backtrack(raw[k])
                out += [ids[done : bounds[k] - lengths[k]], np.array(redone, np.int32)]
                done = bounds[k]
                lengths[k] = len(redone)
            ids = np.concatenate([*out, ids[done:]])
        self._store(pieces, lengths, ids)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of texts; null and empty texts have no ids."""
        find = self.find
        parts = [find(t) if t else [] for t in texts]
        new = set().union(*parts)
        if len(self.place) + len(new) > _MEMO_PIECES:
            self._forget()
        new.difference_update(self.place)
        if new:
            self._encode_pieces(list(new))
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        seq = np.fromiter(map(self.place.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        start, size = self.starts[seq], self.starts[seq + 1] - self.starts[seq]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])]
        return upto[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32), ids


def ranks_of(content: bytes) -> dict[bytes, int]:
    """Entry to rank, from the content of a vocabulary file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The content of a vocabulary file of the driver's for all executors, which needn't have it; a megabyte or so."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


@lru_cache(maxsize=2)
def encoder(content: bytes) -> BpeEncoder:
    """One encoder for each Python worker."""
    return BpeEncoder(ranks_of(content))


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids", path: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``key`` and the list of token ids of ``text``, one row for each row of ``docs``, no shuffle."""
    kind = docs.schema[key].dataType.simpleString()
    content = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(content.value)
        for chunk in text_chunks(batches, 1):
            offsets, ids = bpe.encode_batch(chunk.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[key, out])

    return map_batches(docs.select(docs[key], docs[text]), run, f"`{key}` {kind}, `{out}` array<int>")
