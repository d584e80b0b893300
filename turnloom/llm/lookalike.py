"""One consistent form for text that reads the same.

Strings and code points of one look are joined by union-find into classes:
full-width and half-width forms, radicals and compatibility ideographs,
ligatures, kinds of space and hyphen, invisible characters (the class of the
empty string) and letters of the same shape from other scripts.  Joining is
transitive, so a full-width form of a look-alike falls into the class of the
plain letter.  The representative of a class is its most frequent member in
the corpus (ties: the smaller string), and a text is rewritten greedily, longest
member first, by a multi-pattern automaton.  Canonical decomposition before
and composition after make the order and the composing of accents the same.

What a reader can tell apart stays apart: letters, digits, accents, capitals,
superscripts, the number of spaces and line breaks.  White space at line ends
counts as text.  Null texts have a null form; empty texts have an empty one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.batches import text_chunks
from turnloom.llm.shapes import PAIRS
from turnloom.session import cut, map_batches

# Kinds of hyphen.
HYPHENS = "-‐‑‒–−﹣"
# Invisible characters that aren't of the category Cf.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
#: Format characters that can be seen.
_VISIBLE_FORMAT = set(range(0x600, 0x606)) | {0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return {k: v for k, v in out.items() if len(v) > 1}


def _folded(cp: int) -> str | None:
    """What a code point looks like, by the decomposition that the Unicode database gives it."""
    kind, _, rest = unicodedata.decomposition(chr(cp)).partition("> ")
    if not rest:
        return None
    form = "".join(chr(int(x, 16)) for x in rest.split())
    plain = kind in ("<wide", "<narrow") or kind == "<noBreak" and form.strip() == ""
    same = kind == "<compat" and (0x2E80 <= cp <= 0x2FDF or 0xFB00 <= cp <= 0xFB06 or 0x2160 <= cp <= 0x217F)
    return form if plain or same else None


def look_alike_classes() -> dict[str, list[str]]:
    """All classes with two members or more; members in canonical decomposition."""
    c = Classes()
    nfd = lambda s: unicodedata.normalize("NFD", s)
    for cp in range(0x80, 0x30000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Zs":
            c.join(ch, " ")
        elif kind == "Cf" and cp not in _VISIBLE_FORMAT or 0xFE00 <= cp <= 0xFE0F:
            c.join(ch, "")
        elif (form := _folded(cp)) is not None:
            c.join(nfd(ch), nfd(form))
    for cp in range(0xE0000, 0xE0200):
        c.join(chr(cp), "")
    for ch in INVISIBLE:
        c.join(ch, "")
    for ch in HYPHENS:
        c.join(ch, "-")
    for a, b in PAIRS:
        c.join(nfd(a), nfd(b))
    return c.members()


def _ranges(chars: set[str]) -> list[tuple[str, str]]:
    """First and last of every run of code points; what lies above the basic plane is one run.  A class of single
    characters there would be tried one by one at every character of a text; a character within a run that is in no
    class is left as it is by the automaton."""
    out: list[tuple[str, str]] = []
    for ch in sorted(chars):
        if out and (ord(ch) == ord(out[-1][1]) + 1 or out[-1][0] > "\uffff"):
            out[-1] = (out[-1][0], ch)
        else:
            out.append((ch, ch))
    return out


class Rewriter:
    """Rewrites text so that every member of a class becomes the representative."""

    def __init__(self, representative: dict[str, str]):
        import ahocorasick

        self.change = {m: r for m, r in representative.items() if m and m != r}
        self.automaton = ahocorasick.Automaton()
        for m, r in self.change.items():
            self.automaton.add_word(m, (len(m), r))
        self.automaton.make_automaton()
        self.suspects = re.compile("[" + "".join(f"{re.escape(a)}-{re.escape(b)}" for a, b in _ranges({ch for m in self.change for ch in m})) + "]+")
        self.memo: dict[str, str] = {}

    def _run(self, found: re.Match) -> str:
        run = found.group()
        known = self.memo.get(run)
        if known is None:
            out, at = [], 0
            for end, (n, new) in self.automaton.iter_long(run):
                out += [run[at : end + 1 - n], new]
                at = end + 1
            known = "".join([*out, run[at:]])
            if len(self.memo) > 200_000:
                self.memo.clear()
            if len(run) <= 40:
                self.memo[run] = known
        return known

    def __call__(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFD", text)
        text = self.suspects.sub(self._run, text)
        return text if text.isascii() else unicodedata.normalize("NFC", text)


def choose_representatives(classes: dict[str, list[str]], counts: dict[str, int]) -> dict[str, str]:
    """Member to representative: the most frequent, then the smaller string; the empty string where it is a member."""
    out: dict[str, str] = {}
    for members in classes.values():
        best = "" if "" in members else min(members, key=lambda m: (-counts.get(m, 0), m))
        out.update(dict.fromkeys(members, best))
    return out


def member_counts(docs: DataFrame, text: str, classes: dict[str, list[str]]) -> dict[str, int]:
    """How often every member of a class occurs in the whole corpus.  Each task sends one row for each member it saw,
    so what reaches the driver is bounded by the table of classes, not by the corpus."""
    singles = sorted({ord(m) for v in classes.values() for m in v if len(m) == 1})
    strings = sorted({m for v in classes.values() for m in v if len(m) > 1})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, multi = np.zeros(0x110000, np.int64), dict.fromkeys(strings, 0)
        seen = False
        for chunk in text_chunks(batches, 0):
            joined = "\n".join(t for t in chunk.column(0).to_pylist() if t)
            if not joined.isascii():
                joined = unicodedata.normalize("NFD", joined)
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            if len(codes):
                part = np.bincount(codes)
                total[: len(part)] += part
                for s in strings:
                    if all(total[ord(ch)] for ch in s):
                        multi[s] += joined.count(s)
            seen = True
        if seen:
            rows = [(chr(cp), int(total[cp])) for cp in singles if total[cp]] + [(s, n) for s, n in multi.items() if n]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["member", "n"])

    rows = map_batches(docs.select(docs[text]), run, "member string, n bigint").groupBy("member").agg(F.sum("n").alias("n")).collect()
    return {r.member: r.n for r in rows}


def rewriting(docs: DataFrame, text: str = "text") -> dict[str, str]:
    """Member to representative, by the frequencies in ``docs``."""
    classes = look_alike_classes()
    return choose_representatives(classes, member_counts(docs, text, classes))


def consistent_form(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "form") -> DataFrame:
    """``key`` and the consistent form of ``text``, one row for each row."""
    table, kind = rewriting(docs, text), docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(table)
        for chunk in text_chunks(batches, 1):
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array([None if t is None else rewrite(t) for t in chunk.column(1).to_pylist()], pa.string())], names=[key, out])

    return map_batches(docs.select(docs[key], docs[text]), run, f"`{key}` {kind}, `{out}` string")


def _signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """For every text with something to see: 128 bits of its form and 128 bits of the text itself."""
    table, kind = rewriting(docs, text), docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite, digest = Rewriter(table), xxhash.xxh3_128_digest
        for chunk in text_chunks(batches, 1):
            keep, forms, raws = [], [], []
            for k, t in enumerate(chunk.column(1).to_pylist()):
                if t and (form := rewrite(t)).strip():
                    keep.append(k)
                    forms.append(digest(form.encode("utf-8", "surrogatepass")))
                    raws.append(digest(t.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([chunk.column(0).take(pa.array(keep, pa.int64())), pa.array(forms, pa.binary()), pa.array(raws, pa.binary())], names=["id", "form", "raw"])

    return map_batches(docs.select(docs[key], docs[text]), run, f"id {kind}, form binary, raw binary")


def same_reading_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of keys whose texts differ in their characters and have one form.

    Equal texts are first brought together, so a text that occurs a million times is one variant of its form; only
    forms with several variants are joined, variant with variant, and the ids come back last.  Rows with a null key,
    a null text or nothing visible take no part; a key given twice counts once.
    """
    rows = cut(_signatures(docs, key, text).where("id is not null"))
    variants = rows.select("form", "raw").distinct()
    several = variants.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    variants = variants.join(several, "form")
    # the ids of the variants that matter, few against the corpus
    ids = rows.join(variants, ["form", "raw"], "left_semi").distinct()
    other = variants.select("form", F.col("raw").alias("raw_b"))
    pairs = variants.withColumnRenamed("raw", "raw_a").join(other, "form").where("raw_a < raw_b").drop("form")
    left = ids.select(F.col("raw").alias("raw_a"), F.col("id").alias("a"))
    right = ids.select(F.col("raw").alias("raw_b"), F.col("id").alias("b"))
    found = pairs.join(left, "raw_a").join(right, "raw_b").where("a <> b")
    return found.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b")).distinct()
