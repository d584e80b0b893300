"""Records that say nearly the same: pairs and groups above a likeness.

Likeness is the Jaccard index of the sets of three-character sequences of the
lower-cased letters and digits.  The steps:

1. Every text becomes a parity sketch (bit b is the parity of the sequences
   that hash to b) of 256 bits, or of more, in proportion to the set, and, from min-hashes taken two at a time, a few
   block keys.  Texts of likeness s miss a common block with probability
   (1 - s^2)^bands: 0.2 % at 0.6 with the 14 bands set here, 0.05 % at 0.65,
   0.001 % at 0.75; the tests measure the recall against brute force.  Without
   bands (0) all texts of a source are one block: every pair of tiles is then
   compared that set sizes and bit counts allow, and nothing is lost.
2. Within a block, tiles of sketches are compared exactly with exclusive-or and
   bit counts.  Sets of likeness t or more differ in at most
   (1-t)/(1+t) * (|a|+|b|) members, and sketches never differ in more bits than
   the sets do in members, so that is the radius; pairs, and whole tile pairs,
   whose set sizes or bit counts differ too much are skipped.  The filter loses
   nothing.
3. What passes is checked on the sequences themselves.

Exact copies (equal after lower-casing and dropping) are one text throughout:
their ids come back at the end.  Blocks larger than ``TILE`` rows don't stay in
one task: where a part of the rows shows them beforehand they are cut by set size
and digest before anything is sorted, others after their sort; every pair of
tiles becomes a task of its own.

Defined results: null texts and texts with fewer than three letters or digits
have no likeness to anything; an id given twice counts once; texts of any
length are taken whole.  Ids are bigint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.batches import distinct, text_chunks
from turnloom.llm.leak import folded, mixed
from turnloom.session import cut, map_batches

BANDS, ROWS = 14, 2
#: Bits of the second digest word that hold the set size.
_SIZE = 0xFFFFFFFF
#: Rows of a tile: blocks up to this size are compared where they are.
TILE = 4096
#: Words of the narrowest and the widest sketch, the largest set for the narrowest, and the set size that a word of
#: all others is for.
WORDS, WIDEST, NARROW, PER_WORD = 4, 64, 144, 24
#: Candidate texts up to this number (16 bytes each) are sent to all executors to pick the texts by; more are joined.
SEND_ROWS = 1_000_000
_U = np.uint64
_LOW44 = _U((1 << 44) - 1)


def _multipliers(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def width(size: int) -> int:
    """Words of the sketch of a set: a power of two, so that a wide sketch folds to a narrow one by exclusive-or."""
    n = WORDS
    while size > NARROW and size > PER_WORD * n and n < WIDEST:
        n *= 2
    return n


def radius(t: float, total: np.ndarray) -> np.ndarray:
    """How many members two sets of likeness t can differ in, from the sum of their sizes."""
    return np.floor((1 - t) / (1 + t) * total + 1e-9)


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of all texts one after another, and the text of each."""
    codes, owner = folded([(t or "").lower() for t in texts])
    keep = codes > 0
    return codes[keep], owner[keep]


class Sketches:
    """Of the texts of a chunk: place, digest, number of different sequences, sketch and block keys."""

    def __init__(self, texts: list[str | None], salt: str, bands: int = BANDS):
        codes, owner = normalised(texts)
        start = np.searchsorted(owner, np.arange(len(texts)))
        end = np.searchsorted(owner, np.arange(len(texts)), side="right")
        self.place = np.flatnonzero(end - start >= 3)
        self.codes, self.start, self.end, self.salt = codes, start, end, salt
        if not len(self.place):
            return
        c = codes.astype(np.uint64)
        grams = mixed(c[:-2] << _U(42) | c[1:-1] << _U(21) | c[2:]) & _LOW44
        one = owner[2:] == owner[:-2]
        key = distinct(owner[:-2][one].astype(np.uint64) << _U(44) | grams[one])
        of, grams = (key >> _U(44)).astype(np.int64), key & _LOW44
        first = np.searchsorted(of, self.place)
        self.size = np.diff(np.append(first, len(of)))
        bit = _U(1) << (grams & _U(63))
        word = (grams >> _U(6)).astype(np.int64)
        self.sketch = [np.bitwise_xor.reduceat(np.where(word & WORDS - 1 == w, bit, _U(0)), first) for w in range(WORDS)]
        self.wide: list[bytes | None] = [None] * len(self.place)
        ends = np.append(first, len(of))
        for k in np.flatnonzero(self.size > NARROW).tolist():
            n = width(int(self.size[k]))
            own = np.zeros(n, np.uint64)
            np.bitwise_xor.at(own, word[ends[k] : ends[k + 1]] & n - 1, bit[ends[k] : ends[k + 1]])
            self.wide[k] = own.tobytes()
        own = _U(xxhash.xxh64_intdigest(salt))
        if not bands:
            self.keys = [np.full(len(self.place), own)]
            return
        spread = mixed(grams)
        low = [np.minimum.reduceat(spread * a ^ (spread >> _U(7)), first) for a in _multipliers(bands * ROWS)]
        self.keys = [mixed(low[ROWS * b] * _U(0x9FB21C651E98DF25) + mixed(low[ROWS * b + 1] + _U(b)) + own) for b in range(bands)]

    def digests(self) -> list[bytes]:
        raw, digest, head = self.codes, xxhash.xxh3_128_digest, self.salt.encode()
        return [digest(head + raw[self.start[p] : self.end[p]].tobytes()) for p in self.place.tolist()]


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


#: Rows, about, that say which blocks are large.
LOOKED_AT = 20_000


def _order(size: np.ndarray, da: np.ndarray) -> np.ndarray:
    """Set size and digest as one number that orders the rows of a block."""
    return size.astype(np.uint64) << _U(32) | da >> _U(32)


def large_blocks(docs: DataFrame, bands: int, tile: int) -> dict[int, np.ndarray]:
    """Key to the borders of its tiles (set size, then digest) for blocks that hold more than ``tile`` rows, by what a
    bounded part of the rows says.  It decides only where rows go: a large block that it doesn't show is cut into
    tiles later, after one sort."""
    every = max(1, docs.count() // LOOKED_AT)
    some = docs.where(F.pmod(F.xxhash64("src", "id"), F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, 1):
            for src, part in _by_source(chunk):
                s = Sketches(part.column(1).to_pylist(), src, bands)
                if len(s.place):
                    order = _signed(_order(s.size, _halves(s.digests())[0]))
                    for key in s.keys:
                        yield pa.RecordBatch.from_arrays([_signed(key), order], names=["key", "place"])

    seen = map_batches(some.select("src", "text"), run, "key bigint, place bigint").groupBy("key").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("place")).alias("places"))
    out = {}
    for r in seen.where(F.col("n") * every > tile).collect():  # at most the rows looked at, once a band
        places, tiles = np.array(r.places, np.int64).view(np.uint64), -(-r.n * every // tile)
        out[r.key & 0xFFFFFFFFFFFFFFFF] = np.sort(places)[np.arange(1, tiles) * len(places) // tiles]
    return out


def _tile_of(large: dict[int, np.ndarray], keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The tile, from 1, of every row of a large block; 0 for all others."""
    out = np.zeros(len(keys), np.int64)
    if large:
        names = np.array(sorted(large), np.uint64)
        near = names[np.minimum(np.searchsorted(names, keys), len(names) - 1)] == keys
        for key in distinct(keys[near]).tolist():
            here = keys == _U(key)
            out[here] = np.searchsorted(large[key], order[here], side="right") + 1
    return out


def _blocks(docs: DataFrame, bands: int, tile: int = TILE) -> DataFrame:
    """One row for each text and block: key, digest (96 bits) with the set size, tile, sketch.  A text that a task has met
    before is left out, so copies reach the shuffle once a task at most."""

    large = docs.sparkSession.sparkContext.broadcast(large_blocks(docs, bands, tile))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for chunk in text_chunks(batches, 1):
            for src, part in _by_source(chunk):
                s = Sketches(part.column(1).to_pylist(), src, bands)
                if not len(s.place):
                    continue
                digests, new = s.digests(), []
                for k, d in enumerate(digests):
                    if d not in met:
                        met.add(d)
                        new.append(k)
                if len(met) > 1_000_000:
                    met.clear()
                if not new:
                    continue
                pick = np.array(new)
                a, b = _halves([digests[k] for k in new])
                b = (b & ~_U(_SIZE)) | s.size[pick].astype(np.uint64)
                narrow = s.size[pick] <= NARROW  # a wide sketch folds to the narrow one: that is left out beside it
                fixed = [np.tile(x, len(s.keys)) for x in (a, b, *(np.where(narrow, w[pick], _U(0)) for w in s.sketch))]
                wide = pa.array([s.wide[k] for k in new] * len(s.keys), pa.binary())
                keys, order = np.concatenate([k[pick] for k in s.keys]), np.tile(_order(s.size[pick], a), len(s.keys))
                yield pa.RecordBatch.from_arrays([*(_signed(x) for x in (keys, *fixed)), wide, pa.array(_tile_of(large.value, keys, order))], names=[*_BLOCK, "wide", "tile"])

    return map_batches(docs.select("src", "text"), run, ", ".join(f"{c} bigint" for c in _BLOCK) + ", wide binary, tile bigint")


_BLOCK = ["key", "da", "db", *(f"w{i}" for i in range(WORDS))]
_PAIR = ["kind", "a0", "a1", "b0", "b1"]


def _by_source(chunk: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    import pyarrow.compute as pc

    for src in pc.unique(chunk.column(0)).to_pylist():
        yield src, chunk.filter(pc.equal(chunk.column(0), src))


class Rows:
    """Texts of blocks: two digest words, the words of the narrow sketch, and the wide sketches where there are."""

    def __init__(self, key: np.ndarray, fixed: np.ndarray, wide: np.ndarray):
        self.key, self.fixed, self.wide = key, fixed, wide
        self.size = (fixed[:, 1] & _U(_SIZE)).astype(np.int64)

    @classmethod
    def of(cls, batch: pa.RecordBatch, key: int, first: int, wide: int) -> Rows:
        fixed = np.stack([batch.column(k).to_numpy().view(np.uint64) for k in range(first, first + 2 + WORDS)], 1)
        wider = np.array(batch.column(wide).to_pylist() + [None], object)[:-1]
        by_length: dict[int, list[int]] = {}
        for k, raw in enumerate(wider):
            if raw is not None:
                by_length.setdefault(len(raw), []).append(k)
        for at in by_length.values():
            all_words = np.frombuffer(b"".join(wider[at]), np.uint64).reshape(len(at), -1, WORDS)
            fixed[at, 2:] = np.bitwise_xor.reduce(all_words, axis=1)
        return cls(batch.column(key).to_numpy().view(np.uint64), fixed, wider)

    @classmethod
    def none(cls) -> Rows:
        return cls(np.zeros(0, np.uint64), np.zeros((0, 2 + WORDS), np.uint64), np.zeros(0, object))

    def __len__(self) -> int:
        return len(self.key)

    def __getitem__(self, pick) -> Rows:
        return Rows(self.key[pick], self.fixed[pick], self.wide[pick])

    def plus(self, other: Rows) -> Rows:
        return Rows(np.concatenate([self.key, other.key]), np.concatenate([self.fixed, other.fixed]), np.concatenate([self.wide, other.wide]))

    def without_copies(self) -> Rows:
        """Rows of one key are in order of set size and digest: copies from other tasks lie next to each other."""
        f, k = self.fixed, self.key
        return self[np.concatenate([[True], (k[1:] != k[:-1]) | (f[1:, 0] != f[:-1, 0]) | (f[1:, 1] != f[:-1, 1])])]

    def tiles(self, step: int) -> list[tuple[int, int]]:
        """Spans of at most ``step`` rows whose sketches have one width; rows in order of set size."""
        wide = np.array([WORDS, *(width(n) for n in np.unique(self.size).tolist())])[1 + np.searchsorted(np.unique(self.size), self.size)]
        cuts = [0, *(np.flatnonzero(wide[1:] != wide[:-1]) + 1).tolist(), len(wide)]
        return [(at, min(at + step, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for at in range(a, b, step)]

    def sketches(self, words: int, pick: np.ndarray | None = None) -> np.ndarray:
        """Sketches of so many words; the rows picked must have that width or more."""
        if words == WORDS:
            return self.fixed[:, 2:] if pick is None else self.fixed[pick, 2:]
        out = np.zeros((len(self.wide), words), np.uint64) if pick is None else np.zeros((len(pick), words), np.uint64)
        for i, raw in enumerate(self.wide if pick is None else self.wide[pick]):
            out[i] = np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, words))
        return out


class Tiles:
    """Exact comparison of sketches, tile against tile."""

    def __init__(self, t: float):
        self.t = t

    def between(self, x: Rows, y: Rows, same: bool, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs within the radius.  Both sides are in order of set size."""
        left, right = [], []
        known: dict[tuple[bool, int, int], np.ndarray] = {}

        def tile(rows: Rows, second: bool, at: int, to: int, words: int) -> np.ndarray:
            if (second, at, words) not in known:
                if len(known) > 64:
                    known.clear()
                known[second, at, words] = np.ascontiguousarray(rows[at:to].sketches(words))
            return known[second, at, words]

        tx, ty = x.tiles(step), y.tiles(step)
        for i, to_i in tx:
            na = x.size[i:to_i]
            for j, to_j in ty:
                if same and j < i:
                    continue
                nb = y.size[j:to_j]
                if nb[-1] < self.t * na[0] - 1e-9 or na[-1] < self.t * nb[0] - 1e-9:
                    continue
                words = width(int(min(na[0], nb[0])))
                a, b = tile(x, False, i, to_i, words), tile(y, not same, j, to_j, words)
                ca, cb = np.bitwise_count(a).sum(1).astype(np.int64), np.bitwise_count(b).sum(1).astype(np.int64)
                most = radius(self.t, na[-1] + nb[-1])
                if ca.min() - cb.max() > most or cb.min() - ca.max() > most:
                    continue
                apart = np.zeros((len(a), len(b)), np.uint16)
                for w in range(words):
                    apart += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
                ok = apart <= radius(self.t, na[:, None] + nb[None, :])
                ok &= (na[:, None] >= self.t * nb[None, :] - 1e-9) & (nb[None, :] >= self.t * na[:, None] - 1e-9)
                if same and i == j:
                    ok &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
                p, q = np.nonzero(ok)
                left.append(p + i)
                right.append(q + j)
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(left), np.concatenate(right)

    def within_runs(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of one key; rows in order of key and set size.  Short runs of all keys at a time: row i
        against row i + d, for every distance d that still stays within some run; long runs by tiles."""
        key, size = rows.key, rows.size
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(cuts, len(key)))
        left, right = [], []
        for at, n in zip(cuts[length > 24].tolist(), length[length > 24].tolist(), strict=True):
            p, q = self.between(rows[at : at + n], rows[at : at + n], True)
            left.append(p + at)
            right.append(q + at)
        stop = np.repeat(cuts + length, length)
        i = np.flatnonzero(np.repeat((length > 1) & (length <= 24), length))
        d = 1
        while True:
            i = i[i + d < stop[i]]
            i = i[size[i] >= self.t * size[i + d] - 1e-9]  # later rows of the run are larger still
            if not len(i):
                break
            near = i[np.bitwise_count(rows.fixed[i, 2:] ^ rows.fixed[i + d, 2:]).sum(1) <= radius(self.t, size[i] + size[i + d])]
            # sketches of large sets are wider than what has been compared so far
            more = size[near] > NARROW
            left.append(near[~more])
            right.append(near[~more] + d)
            for k in near[more].tolist():
                words = width(int(size[k]))
                a, b = rows.sketches(words, np.array([k])), rows.sketches(words, np.array([k + d]))
                if np.bitwise_count(a ^ b).sum() <= radius(self.t, size[k] + size[k + d]):
                    left.append(np.array([k]))
                    right.append(np.array([k + d]))
            d += 1
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(left), np.concatenate(right)


def _pairs_out(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Digests of pairs, each pair one way round, without pairs of a text with itself."""
    a0, a1, b0, b1 = x[:, 0], x[:, 1], y[:, 0], y[:, 1]
    swap = (a0 > b0) | ((a0 == b0) & (a1 > b1))
    out = np.stack([np.where(swap, b0, a0), np.where(swap, b1, a1), np.where(swap, a0, b0), np.where(swap, a1, b1)], 1)
    out = np.unique(out[(out[:, 0] != out[:, 2]) | (out[:, 1] != out[:, 3])], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(out), np.int64)), *(_signed(out[:, k]) for k in range(4))], names=_PAIR)


def candidate_pairs(blocks: DataFrame, t: float, tile: int = TILE) -> DataFrame:
    """Digests of texts whose sketches lie within the radius."""
    names = [*_PAIR, *(f"w{i}" for i in range(WORDS)), "wide"]
    schema = ", ".join(f"{c} bigint" for c in names[:-1]) + ", wide binary"

    def full(batch: pa.RecordBatch) -> pa.RecordBatch:
        none = pa.nulls(batch.num_rows, pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns, *[none] * WORDS, pa.nulls(batch.num_rows, pa.binary())], names=names)

    def passed(rows: Rows, at: int, number: np.ndarray | None = None) -> pa.RecordBatch:
        number = np.arange(at, at + len(rows)) // tile + 1 if number is None else number
        fixed = [_signed(rows.fixed[:, k]) for k in range(2 + WORDS)]
        return pa.RecordBatch.from_arrays([pa.array(number), _signed(rows.key), pa.array(np.zeros(len(rows), np.int64)), *fixed, pa.array(rows.wide.tolist(), pa.binary())], names=names)

    def done(rows: Rows, tiles: Tiles) -> Iterator[pa.RecordBatch]:
        """Complete blocks: those longer than a tile are passed on, all others compared."""
        if not len(rows):
            return
        cuts = np.flatnonzero(np.concatenate([[True], rows.key[1:] != rows.key[:-1]]))
        length = np.diff(np.append(cuts, len(rows)))
        big = length > tile
        for at, n in zip(cuts[big].tolist(), length[big].tolist(), strict=True):
            yield passed(rows[at : at + n], 0)
        rows = rows[~np.repeat(big, length)]
        if len(rows):
            p, q = tiles.within_runs(rows)
            if len(p):
                yield full(_pairs_out(rows.fixed[p], rows.fixed[q]))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of small blocks; the rows of large ones pass through with the number of their tile, which they have
        already or get here, whatever their number, so that no block is held as a whole."""
        tiles, held, large, seen = Tiles(t), Rows.none(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(4 + WORDS).to_numpy()
            if (number > 0).any():
                yield passed(Rows.of(batch, 0, 1, 3 + WORDS)[number > 0], 0, number[number > 0])
                batch = batch.filter(pa.array(number == 0))
                if not batch.num_rows:
                    continue
            held = held.plus(Rows.of(batch, 0, 1, 3 + WORDS)).without_copies()
            if large is not None:
                n = int(np.searchsorted(np.cumsum(held.key != large), 1))
                if n:
                    yield passed(held[:n], seen)
                    seen += n
                    held = held[n:]
                if not len(held):
                    continue
                large = None
            last = int(np.flatnonzero(np.concatenate([[True], held.key[1:] != held.key[:-1]]))[-1])
            yield from done(held[:last], tiles)
            held = held[last:]
            if len(held) > tile:
                large, seen = held.key[0], len(held)
                yield passed(held, 0)
                held = Rows.none()
        yield from done(held, tiles)

    size = F.col("db").bitwiseAND(_SIZE)
    route = F.when(F.col("tile") == 0, F.col("key")).otherwise(F.xxhash64("key", "tile"))
    ordered = blocks.repartition(route).sortWithinPartitions("key", size, "da", "db")
    first = cut(map_batches(ordered, small, schema))
    pairs = first.where("kind = 0").select(*_PAIR[1:])
    rows = first.where("kind > 0").select(F.col("a0").alias("key"), F.col("kind").alias("tile"), F.col("b0").alias("da"), F.col("b1").alias("db"), *names[5:])
    spans = rows.groupBy("key", "tile").agg(F.min(size).alias("lo"), F.max(size).alias("hi"))
    if spans.isEmpty():
        return pairs.distinct()
    # pairs of tiles whose set sizes can reach the likeness; the number of tiles is the rows of large blocks over TILE
    a, b = spans.select("key", *(F.col(c).alias(f"{c}_a") for c in ("tile", "lo", "hi"))), spans.select("key", *(F.col(c).alias(f"{c}_b") for c in ("tile", "lo", "hi")))
    cells = a.join(b, "key").where((F.col("tile_a") <= F.col("tile_b")) & (F.col("hi_a") >= t * F.col("lo_b")) & (F.col("hi_b") >= t * F.col("lo_a")))
    cells = cells.select("key", "tile_a", "tile_b").withColumn("cell", F.xxhash64("key", "tile_a", "tile_b"))
    sides = cells.select("key", "cell", F.explode(F.array(F.struct(F.col("tile_a").alias("tile"), F.lit(0).alias("side")), F.struct(F.col("tile_b").alias("tile"), F.lit(1).alias("side")))).alias("s")).select("key", "cell", "s.tile", "s.side")
    laid = sides.join(rows, ["key", "tile"]).select("cell", F.col("side").cast("bigint").alias("side"), "da", "db", *names[5:])

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, held = Tiles(t), None
        for batch in batches:
            if not batch.num_rows:
                continue
            side, new = batch.column(1).to_numpy(), Rows.of(batch, 0, 2, 4 + WORDS)
            for part in np.split(np.arange(len(new)), np.flatnonzero(new.key[1:] != new.key[:-1]) + 1):
                if held is not None and new.key[part[0]] != held[0].key[0]:
                    yield from crossed(tiles, *held)
                    held = None
                held = (new[part], side[part]) if held is None else (held[0].plus(new[part]), np.concatenate([held[1], side[part]]))
        if held is not None:
            yield from crossed(tiles, *held)

    def crossed(tiles: Tiles, rows: Rows, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y = rows[side == 0].without_copies(), rows[side == 1].without_copies()
        p, q = tiles.between(x, y, False)
        if len(p):
            out = _pairs_out(x.fixed[p], y.fixed[q])
            yield pa.RecordBatch.from_arrays(out.columns[1:], names=_PAIR[1:])

    by_cell = laid.repartition("cell").sortWithinPartitions("cell", "side", size, "da", "db")
    return pairs.unionByName(map_batches(by_cell, cell, ", ".join(f"{c} bigint" for c in _PAIR[1:]))).distinct()


def _texts(docs: DataFrame) -> DataFrame:
    """Source, id, digest and normalised text of every record that has a likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, 2):
            for src, part in _by_source(chunk):
                texts = part.column(2).to_pylist()
                codes, owner = normalised(texts)
                start = np.searchsorted(owner, np.arange(len(texts)))
                end = np.searchsorted(owner, np.arange(len(texts)), side="right")
                place, raw, head = np.flatnonzero(end - start >= 3), codes, src.encode()
                if not len(place):
                    continue
                pieces = [raw[start[p] : end[p]].tobytes() for p in place.tolist()]
                a, b = _halves([xxhash.xxh3_128_digest(head + x) for x in pieces])
                b = b & ~_U(_SIZE)
                ids = part.column(1).take(pa.array(place))
                text = pa.array([x.decode("utf-32-le", "surrogatepass") for x in pieces], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([src] * len(place), pa.string()), ids, _signed(a), _signed(b), text], names=["src", "id", "d0", "d1", "norm"])

    return map_batches(docs.select("src", "id", "text"), run, "src string, id bigint, d0 bigint, d1 bigint, norm string")


def likeness(left: list[str], right: list[str], t: float = 0.0) -> np.ndarray:
    """Of pairs of normalised texts, on their sequences, exactly: sequences get numbers, and of each pair the numbers
    that both sides have are counted by one sort.  Pairs whose sketches of 2048 bits are beyond the radius of ``t``
    are not counted and get 0."""
    texts = list(dict.fromkeys([*left, *right]))
    at = {t: k for k, t in enumerate(texts)}
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), lengths)
    grams = c[:-2] << _U(42) | c[1:-1] << _U(21) | c[2:]
    one = of[2:] == of[:-2]
    of, (names, number) = of[:-2][one], np.unique(grams[one], return_inverse=True)
    each = distinct(of * len(names) + number)
    of, number = each // len(names), each % len(names)
    start = np.searchsorted(of, np.arange(len(texts) + 1))
    size = np.diff(start)

    x, y = (np.fromiter((at[t] for t in side), np.int64, len(side)) for side in (left, right))
    out, open_ = np.zeros(len(x)), np.arange(len(x))
    if t > 0:
        bits = np.bincount(of << 11 | (mixed(names)[number] & _U(2047)).astype(np.int64), minlength=len(texts) << 11).astype(np.uint8) & 1
        sketch = np.packbits(bits.reshape(-1, 2048), axis=1).view(np.uint64)
        apart = np.zeros(len(x), np.int64)
        for w in range(sketch.shape[1]):
            apart += np.bitwise_count(sketch[x, w] ^ sketch[y, w])
        open_ = np.flatnonzero(apart <= radius(t, size[x] + size[y]))
        x, y = x[open_], y[open_]

    def laid(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = size[k]
        take = np.repeat(start[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(k)), n) * len(names) + number[take], n

    if len(x):
        (a, na), (b, nb) = laid(x), laid(y)
        both = np.sort(np.concatenate([a, b]))
        shared = np.bincount(both[1:][both[1:] == both[:-1]] // len(names), minlength=len(x))
        out[open_] = shared / (na + nb - shared)
    return out


def _alike(pairs: DataFrame, t: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, 4, 5, size=1 << 20):
            s = likeness(chunk.column(4).to_pylist(), chunk.column(5).to_pylist(), t)
            keep = pa.array(np.flatnonzero(s >= t - 1e-12))
            yield pa.RecordBatch.from_arrays([*(chunk.column(k).take(keep) for k in range(4)), pa.array(s).take(keep)], names=["a0", "a1", "b0", "b1", "likeness"])

    return map_batches(pairs, run, "a0 bigint, a1 bigint, b0 bigint, b1 bigint, likeness double")


def near_texts(docs: DataFrame, t: float = 0.6, bands: int = BANDS, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(members, links).  ``docs`` has ``src``, ``id`` and ``text``.  Members: ``src``, ``id`` and the digest
    (``d0``, ``d1``) of its text.  Links: pairs of digests of different texts of one source, with their likeness."""
    candidates = cut(candidate_pairs(_blocks(docs, bands, tile), t, tile))
    plain = F.col("a1").bitwiseAND(~_SIZE), F.col("b1").bitwiseAND(~_SIZE)
    candidates = candidates.select("a0", plain[0].alias("a1"), "b0", plain[1].alias("b1"))
    texts = _texts(docs)
    wanted = candidates.select(F.col("a0").alias("d0"), F.col("a1").alias("d1")).unionByName(candidates.select(F.col("b0").alias("d0"), F.col("b1").alias("d1"))).distinct()
    wanted = cut(wanted)
    if wanted.count() <= SEND_ROWS:  # the texts that matter are picked before anything is shuffled
        wanted = F.broadcast(wanted)
    texts_of = texts.select("d0", "d1", "norm").join(wanted, ["d0", "d1"], "left_semi").dropDuplicates(["d0", "d1"])
    with_a = candidates.join(texts_of.select(F.col("d0").alias("a0"), F.col("d1").alias("a1"), F.col("norm").alias("x")), ["a0", "a1"])
    with_b = with_a.join(texts_of.select(F.col("d0").alias("b0"), F.col("d1").alias("b1"), F.col("norm").alias("y")), ["b0", "b1"])
    links = _alike(with_b.select("a0", "a1", "b0", "b1", "x", "y"), t)
    return texts.select("src", "id", "d0", "d1").distinct(), links


def near_pairs(docs: DataFrame, t: float = 0.6, bands: int = BANDS, tile: int = TILE) -> DataFrame:
    """All pairs of ids of one source with a likeness of at least ``t``, exact copies included."""
    members, links = near_texts(docs, t, bands, tile)
    members = cut(members.where("id is not null"))
    copies = members.groupBy("d0", "d1").agg(F.count("*").alias("n")).where("n > 1").select("d0", "d1")
    twins = members.join(copies, ["d0", "d1"], "left_semi")
    equal = twins.join(twins.select("d0", "d1", F.col("id").alias("other")), ["d0", "d1"]).where("id < other").select("src", F.col("id").alias("id_a"), F.col("other").alias("id_b"))
    a = members.select("src", F.col("d0").alias("a0"), F.col("d1").alias("a1"), F.col("id").alias("x"))
    b = members.select(F.col("d0").alias("b0"), F.col("d1").alias("b1"), F.col("id").alias("y"))
    near = links.join(a, ["a0", "a1"]).join(b, ["b0", "b1"]).where("x <> y").select("src", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return equal.unionByName(near).distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """``node, label``: the connected components of ``u, v``; the label is the smallest node.  Large and small stars in
    turn: each node hands its larger, then its smaller neighbours to the smallest of them, until nothing changes.  A
    node with any number of neighbours is two aggregates and a join that may be split; no component is collected."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges, mark = cut(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    for _ in range(most):
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = cut(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def near_groups(docs: DataFrame, t: float = 0.6, bands: int = BANDS, tile: int = TILE) -> DataFrame:
    """One row for each record that has a likeness: ``src, id, group_id`` (the smallest id of its group), ``copies`` (records
    with an equal text, itself included) and ``links`` (other texts with a likeness of at least ``t``)."""
    members, links = near_texts(docs, t, bands, tile)
    members = cut(members.where("id is not null"))
    links = cut(links.select(F.struct(F.col("a0").alias("d0"), F.col("a1").alias("d1")).alias("u"), F.struct(F.col("b0").alias("d0"), F.col("b1").alias("d1")).alias("v")))
    texts = members.groupBy("d0", "d1").agg(F.min("id").alias("first"), F.count("*").alias("copies")).withColumn("node", F.struct("d0", "d1"))
    ends = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    texts = texts.join(ends, "node", "left").join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = texts.groupBy("label").agg(F.min("first").alias("group_id"))
    texts = texts.join(groups, "label").select("d0", "d1", "group_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(texts, ["d0", "d1"]).select("src", "id", "group_id", "copies", "links")
