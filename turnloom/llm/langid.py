"""The language of documents and of their segments, with a confidence.

Nearest centroid: a sentence becomes a TF-IDF vector of its character n-grams
(up to four; capitalised words within a sentence are left out), hashed to a fixed number of dimensions and normalised; it is
compared by cosine with several centroids per language, which spherical k-means
finds among the labelled samples.  A sentence further than ``FAR`` from every
centroid, or no nearer to its language than to the next by ``CLEAR``, is
rejected; to count as a whole sentence of a language it has to be nearer by ``SURE``
and to have four words and ``LETTERS`` letters, or eight characters of a wide script.
Sentences are compared only with languages of their kind of script (wide or not).

A document's language is the one with most letters.  It is mixed if it holds a
whole sentence in each of two languages or more; names, terms, code, JSON, mark-
up and role marks make no sentence.  Labels in any usual notation (codes of two
or three letters with or without region or script, names in English or in the
language itself, any case) name their language; everything else names none.

Null and empty texts, and texts with fewer than ``LETTERS`` letters, have no
language and no defect.  Texts of any length are read whole.  The model is
fitted on at most ``SAMPLES`` labelled samples of each language; everything
else covers all rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.batches import text_chunks
from turnloom.llm.leak import mixed
from turnloom.llm.shapes import lower_shapes
from turnloom.session import map_batches

LANGUAGES = ("en", "zh", "fr", "de", "es", "ru", "ja")
DIMENSIONS, CENTROIDS, SAMPLES = 1 << 14, 3, 1000
FAR, CLEAR, SURE, LETTERS = 0.03, 1.3, 1.6, 20
_U = np.uint64

# Names of the languages besides their two-letter codes.
NAMES = {
    "en": "eng english anglais englisch inglés ingles английский 英语 英文 英語",
    "zh": "zho chi cmn chinese mandarin hans hant chinois chinesisch chino китайский 中文 汉语 漢語 中国語 普通话 简体中文 繁體中文",
    "fr": "fra fre french français francais französisch francés французский 法语 法文 フランス語",
    "de": "deu ger german deutsch allemand alemán немецкий 德语 德文 ドイツ語",
    "es": "spa spanish español espanol castellano espagnol spanisch испанский 西班牙语 西班牙文 スペイン語",
    "ru": "rus russian русский russe russisch ruso 俄语 俄文 ロシア語",
    "ja": "jpn japanese 日本語 japonais japanisch japonés японский 日语 日文",
}
_BY_NAME = {w: k for k, v in NAMES.items() for w in (k, *v.split())}


def named_language(label: str | None) -> str | None:
    """The language a label names, None if none."""
    text = (label or "").strip().lower()
    return _BY_NAME.get(text) or _BY_NAME.get(re.split(r"[-_ (（]", text, maxsplit=1)[0]) if text else None


#: What is no prose: fenced and inline code, tags, links, addresses, and role marks at the start of a line.
_NOT_PROSE = re.compile(
    r"```.*?```|`[^`\n]*`|<[/!]?[A-Za-z][^<>\n]*>|https?://\S+|\S+@\S+|^[^\S\n]*[\w ]{2,20}:(?=\s|\{|\[)",
    re.S | re.M,
)
#: Braces, line ends, and whole strings between them.
_BRACE = re.compile(r'"(?:[^"\\\n]|\\.)*"(?=\s*[:,}\]])|[{}\n]')
_CODE_HINT = re.compile(r"[`<{@]|://|^[^\S\n]*[\w ]{2,20}:", re.M)

#: Classes of code points.
OTHER, LETTER, WIDE, MARK, ENDS, DOT, BREAK, SPACE, INNER, UNSEEN = range(10)
#: Cyrillic and Greek letters, lower case, with the Latin letters of their shape.
SHAPES = lower_shapes()


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, lower-case form and capitals of all code points."""
    kind, low, upper = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for cp in range(0x30000):
        ch = chr(cp)
        if ch.isalpha():
            wide = 0x3040 <= cp < 0x3100 or 0x3400 <= cp < 0xA000 or 0xF900 <= cp < 0xFB00 or 0x20000 <= cp or 0x31F0 <= cp < 0x3200
            kind[cp] = WIDE if wide else LETTER
            low[cp] = ord(ch.lower()[0])
            upper[cp] = ch.isupper()
    for cp in (*range(0x2E80, 0x2FE0), *range(0xF900, 0xFB00), *range(0xFF66, 0xFF9E)):
        form = unicodedata.normalize("NFKC", chr(cp))
        if len(form) == 1 and form.isalpha():
            kind[cp], low[cp] = WIDE, ord(form)
    for cp in (0xAD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFE0F, 0xFEFF):
        kind[cp] = UNSEEN
    for cp in (*range(0x300, 0x370), 0x3099, 0x309A):
        kind[cp] = MARK
    for ch in "。！？!?…｡；;":
        kind[ord(ch)] = ENDS
    kind[ord(".")] = DOT
    for ch in "\n\r\v\f\x1c\x1d\x1e\x85  ":
        kind[ord(ch)] = BREAK
    for cp in (9, 32, 0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000):
        kind[cp] = SPACE
    for ch in "'’-":
        kind[ord(ch)] = INNER
    for cp in range(0xFF21, 0xFF5B):
        if kind[cp] == LETTER:
            low[cp] = ord(chr(cp - 0xFEE0).lower())
    return kind, low, upper


def _json_spans(text: str) -> Iterator[tuple[int, int]]:
    """Spans of JSON: from a brace, or a bracket before one, up to the brace that closes it; strings are stepped over.  A
    brace that isn't closed on its line ends nothing but itself."""
    at = text.find("{")
    while at >= 0:
        depth, end = 0, -1
        for m in _BRACE.finditer(text, at):
            ch = m.group()
            if ch == "\n":
                break
            depth += (ch == "{") - (ch == "}")
            if not depth:
                end = m.end()
                break
        if end < 0:
            at = text.find("{", at + 1)
            continue
        start = at - 1 if text[at - 1 : at] == "[" else at
        yield start, end + 1 if text[end : end + 1] == "]" else end
        at = text.find("{", end)


def prose(text: str) -> str:
    """The text with everything that isn't prose blanked out, place by place."""
    if not _CODE_HINT.search(text):
        return text
    text = _NOT_PROSE.sub(lambda m: "\n" * len(m.group()), text)
    if "{" in text:
        out, done = [], 0
        for a, b in _json_spans(text):
            out += [text[done:a], "\n" * (b - a)]
            done = b
        text = "".join([*out, text[done:]])
    return text


class Sentences:
    """The sentences of the texts of a chunk, one after another."""

    def __init__(self, texts: list[str], lines: bool):
        kind, low, upper = tables()
        joined = "\n\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = kind[codes]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
        self.text_start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        after = np.append(kinds[1:], BREAK)
        end = (kinds == ENDS) | (kinds == DOT) & ((after == SPACE) | (after == BREAK) | (after == WIDE)) | (kinds == BREAK) & ((after == BREAK) | lines)
        end[np.minimum(self.text_start[1:] - 1, len(end) - 1)] = True
        nth = np.cumsum(end) - end  # the sentence of each place
        letter = (kinds == LETTER) | (kinds == WIDE)
        count = int(nth[-1]) + 1 if len(nth) else 0
        self.letters = np.bincount(nth[letter], minlength=count)
        self.wide = np.bincount(nth[kinds == WIDE], minlength=count)
        before = np.concatenate([[OTHER], kinds[:-1]])
        word = (kinds == LETTER) & (before != LETTER) & (before != MARK) & (before != INNER)
        self.words = np.bincount(nth[word], minlength=count)
        self.start = np.concatenate([[0], np.flatnonzero(end) + 1])[:count]
        self.stop = np.append(self.start[1:], len(codes))[:count]
        self.text = np.searchsorted(self.text_start, self.start, side="right") - 1
        # capitalised words within a sentence are names, or nouns that are told by the words around them
        inside = letter | (kinds == MARK)
        starts = np.flatnonzero(word)
        if len(starts):
            next_ = np.minimum(starts + 1, len(codes) - 1)
            capital = upper[codes[starts]] & (kinds[next_] == LETTER) & ~upper[codes[next_]]
            capital &= np.concatenate([[False], nth[starts[1:]] == nth[starts[:-1]]])
            within = np.cumsum(word)
            inside &= ~((kinds == LETTER) & np.concatenate([[False], capital])[within])
        # letters with one blank between runs; what is no letter separates
        keep = inside | (np.concatenate([[True], inside[:-1]]) & (kinds != UNSEEN))
        folded, of = np.where(inside, low[codes], 32)[keep], nth[keep]
        # a sentence whose only Cyrillic or Greek letters are those that look Latin is a Latin one
        foreign = (folded >= 0x370) & (folded < 0x530)
        if foreign.any():
            table = np.arange(0x530, dtype=folded.dtype)
            table[[ord(a) for a in SHAPES]] = [ord(b) for b in SHAPES.values()]
            plain = foreign & (table[np.where(foreign, folded, 0)] == folded)
            latin = np.bincount(of[plain], minlength=count) * 8 < np.bincount(of[foreign], minlength=count)
            change = foreign & latin[of]
            folded = np.where(change, table[np.where(change, folded, 0)], folded)
        self.codes, self.of = folded.astype(np.uint64), of

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, dimension) of every n-gram: one to three characters of a wide script, two to four of others."""
        c, of = self.codes, self.of
        wide = (c >= 0x3040) & (c < 0x30000)
        out_s, out_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in (1, 2, 3, 4):
            if len(c) < n:
                continue
            key, same = c[: len(c) - n + 1].copy(), of[n - 1 :] == of[: len(of) - n + 1]
            for j in range(1, n):
                key = key * _U(0x9E3779B97F4A7C15) + c[j : len(c) - n + 1 + j]
            if n == 1:
                same = same & wide
            if n == 4:
                same = same & ~wide[: len(c) - 3] & ~wide[3:]
            out_s.append(of[: len(of) - n + 1][same])
            out_d.append((mixed(key[same] + _U(n)) & _U(DIMENSIONS - 1)).astype(np.int64))
        return np.concatenate(out_s), np.concatenate(out_d)


def vectors(s: Sentences, of: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts (row, dimension, times), rows in order; ``of`` gives the row of a sentence, -1 for none."""
    row, dim = s.grams()
    row = of[row]
    key = row[row >= 0] * DIMENSIONS + dim[row >= 0]
    key = np.sort(key.astype(np.uint32) if count * DIMENSIONS < 1 << 32 else key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key))).astype(np.float32)
    key = key[first].astype(np.int64)
    return key >> DIMENSIONS.bit_length() - 1, key & DIMENSIONS - 1, times


class Model:
    """IDF and centroids; ``weight`` has the centroids times IDF, a row each.  ``wide``: by language, whether its samples
    are written in a wide script; sentences are compared with languages of their kind of script only."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, of: np.ndarray, wide: np.ndarray):
        self.idf, self.of, self.wide = idf, of, wide
        self.weight = np.ascontiguousarray((centroids * idf).astype(np.float32))

    def similarity(self, s: Sentences, pick: np.ndarray) -> np.ndarray:
        """Cosine of the picked sentences with the nearest centroid of every language."""
        place = np.full(len(s.letters), -1, np.int64)
        place[pick] = np.arange(len(pick))
        row, dim, times = vectors(s, place, len(pick))
        out = np.zeros((len(pick), len(LANGUAGES)), np.float32)
        if not len(row):
            return out
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        norm = np.sqrt(np.add.reduceat((times * self.idf[dim]) ** 2, first))
        dots = np.empty((len(first), len(self.of)), np.float32)
        for k, column in enumerate(self.weight):  # a column at a time stays in the cache
            part = column[dim]
            part *= times
            dots[:, k] = np.add.reduceat(part, first)
        dots /= np.maximum(norm, 1e-9)[:, None]
        for k in np.unique(self.of).tolist():
            out[row[first], k] = dots[:, self.of == k].max(1)
        out[(s.wide[pick] * 2 > s.letters[pick])[:, None] != self.wide[None, :]] = 0
        return out


def fit(samples: list[tuple[str, str]], centroids: int = CENTROIDS) -> Model:
    """From (language, text): sentences of the samples, their IDF, and k-means with the cosine in each language."""
    texts = [t for lang, t in samples if lang in LANGUAGES]
    langs = np.array([LANGUAGES.index(lang) for lang, t in samples if lang in LANGUAGES], dtype=np.int64)
    s = Sentences([prose(t) for t in texts], True)
    pick = np.flatnonzero(s.letters >= 8)
    place = np.full(len(s.letters), -1, np.int64)
    place[pick] = np.arange(len(pick))
    row, dim, times = vectors(s, place, len(pick))
    idf = (np.log((1 + len(pick)) / (1 + np.bincount(dim, minlength=DIMENSIONS))) + 1).astype(np.float32)
    dense = np.zeros((len(pick), DIMENSIONS), np.float32)
    dense[row, dim] = times * idf[dim]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    found, of = [np.zeros((0, DIMENSIONS), np.float32)], []
    for k in range(len(LANGUAGES)):
        x = dense[langs[s.text[pick]] == k]
        if not len(x):
            continue
        centre = x.mean(0)
        chosen = [int(np.argmax(x @ centre))]  # then each time what is furthest from all chosen
        while len(chosen) < min(centroids, len(x)):
            chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
        c = x[chosen].copy()
        for _ in range(20):
            near = np.argmax(x @ c.T, 1)
            for j in range(len(c)):
                if (near == j).any():
                    c[j] = x[near == j].mean(0)
                    c[j] /= max(float(np.linalg.norm(c[j])), 1e-9)
        found.append(c)
        of += [k] * len(c)
    letters, wide = (np.bincount(langs[s.text], n, len(LANGUAGES)) for n in (s.letters, s.wide))
    return Model(idf, np.concatenate(found), np.array(of, dtype=np.int64), wide * 2 > letters)


def fit_languages(reference: DataFrame, lang: str = "lang", text: str = "text", samples: int = SAMPLES) -> Model:
    """The model of a table of labelled samples: of each language the first ``samples`` by text, so that what comes to
    the driver is bounded."""
    nth = F.row_number().over(Window.partitionBy(lang).orderBy(text))
    rows = reference.where(F.col(text).isNotNull() & F.col(lang).isin(*LANGUAGES)).select(lang, text, nth.alias("nth")).where(F.col("nth") <= samples).collect()
    return fit([(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[0], r[1]))])


class Judged:
    """Languages of the sentences of a chunk of texts.  ``composed``: accents are first put together with their
    letters, after which places in the text are no longer those of the original."""

    def __init__(self, model: Model, texts: list[str | None], lines: bool = True, composed: bool = True):
        texts = [prose(t or "") for t in texts]
        if composed:
            texts = [t if t.isascii() else unicodedata.normalize("NFC", t) for t in texts]
        self.s = s = Sentences(texts, lines)
        self.texts = len(texts)
        pick = np.flatnonzero(s.letters >= 2)
        sim = model.similarity(s, pick)
        best = np.argmax(sim, 1) if len(pick) else np.zeros(0, np.int64)
        top = sim[np.arange(len(pick)), best]
        second = np.partition(sim, -2, axis=1)[:, -2] if len(pick) else top
        self.lang = np.full(len(s.letters), -1, np.int64)
        self.confidence = np.zeros(len(s.letters), np.float32)
        self.near = np.zeros((len(s.letters), len(LANGUAGES)), np.float32)
        self.near[pick] = sim
        sure = (top >= FAR) & (top >= CLEAR * second)
        self.lang[pick[sure]] = best[sure]
        self.confidence[pick] = top / np.maximum(top + second, 1e-9)
        # a whole sentence: enough words, or enough characters where words aren't apart, and far ahead of the next language
        ahead = np.zeros(len(s.letters), bool)
        ahead[pick] = top >= SURE * second
        self.whole = (self.lang >= 0) & ahead & ((s.words >= 4) & (s.letters >= LETTERS) & (s.wide * 4 < s.letters) | (s.wide >= 8) & (s.wide * 2 > s.letters))

    def per_text(self, least: int = LETTERS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text: its language (-1 if it is far from all), the languages with a whole sentence, its letters,
        and the confidence.  The language is the only one with a whole sentence, or the one nearest to all
        sentences together, by their letters."""
        s, n = self.s, len(LANGUAGES)
        weight = self.near * s.letters[:, None]
        near = np.stack([np.bincount(s.text, weight[:, k], self.texts) for k in range(n)], 1)
        total = np.bincount(s.text, s.letters, self.texts)
        self.nearness = near
        main = np.argmax(near, 1)
        top, second = near[np.arange(self.texts), main], np.partition(near, -2, axis=1)[:, -2]
        main = np.where((total >= least) & (total > 0) & (top >= FAR * total), main, -1)
        whole = np.bincount(s.text[self.whole] * n + self.lang[self.whole], minlength=self.texts * n).reshape(-1, n) > 0
        one = (main >= 0) & (whole.sum(1) == 1)
        main = np.where(one, np.argmax(whole, 1), main)
        return main, whole, total, top / np.maximum(top + second, 1e-9)


_OUT = "lang string, confidence double, mixed array<string>"


def document_languages(docs: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """``key``, ``lang``, ``confidence`` (0.5 to 1) and, if the text is mixed, all languages with a whole sentence;
    one row for each row, null where a text has no language."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, 1, size=1 << 20):
            main, whole, _, sure = Judged(shared.value, chunk.column(1).to_pylist()).per_text()
            several = (main >= 0) & (whole.sum(1) > 1)
            langs = [LANGUAGES[m] if m >= 0 else None for m in main.tolist()]
            conf = [c if m >= 0 else None for m, c in zip(main.tolist(), sure.tolist(), strict=True)]
            mix = [[LANGUAGES[k] for k in np.flatnonzero(whole[i])] if m else None for i, m in enumerate(several.tolist())]
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(langs, pa.string()), pa.array(conf, pa.float64()), pa.array(mix, pa.list_(pa.string()))], names=[key, "lang", "confidence", "mixed"])

    return map_batches(docs.select(docs[key], docs[text]), run, f"`{key}` {kind}, {_OUT}")


_CLUSTER = re.compile(r".[\u0300-\u036f\u3099\u309a]*", re.S)


def composed_places(text: str) -> tuple[str, np.ndarray | None]:
    """The text with its accents put together, and where each of its characters (and its end) was before; None where
    nothing has moved."""
    if text.isascii() or unicodedata.is_normalized("NFC", text):
        return text, None
    parts, at = [unicodedata.normalize("NFC", m.group()) for m in _CLUSTER.finditer(text)], [m.start() for m in _CLUSTER.finditer(text)]
    return "".join(parts), np.append(np.repeat(at, [len(x) for x in parts]), len(text))


def language_segments(docs: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """Runs of sentences in one language: ``key``, ``start`` and ``stop`` (code points from 0), ``lang``,
    ``confidence``.  Sentences without a language belong to the run they are in.  A text without a whole sentence is one
    segment in its language, if it has one."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, 1, size=1 << 20):
            texts, places = zip(*(composed_places(t or "") for t in chunk.column(1).to_pylist()), strict=True)
            j = Judged(shared.value, texts, composed=False)
            at = np.flatnonzero(j.whole)
            rest = np.setdiff1d(np.arange(len(texts)), j.s.text[at])
            if len(rest):
                main, _, _, sure = Judged(shared.value, [texts[k] for k in rest.tolist()]).per_text()
                told = np.flatnonzero(main >= 0)
                here = rest[told]
                cols = [chunk.column(0).take(pa.array(here)), pa.array(np.zeros(len(here), np.int64)), pa.array([len(texts[k]) if places[k] is None else int(places[k][-1]) for k in here.tolist()], pa.int64()), pa.array([LANGUAGES[k] for k in main[told].tolist()], pa.string()), pa.array(sure[told].astype(np.float64))]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "start", "stop", "lang", "confidence"])
            if not len(at):
                continue
            text, lang = j.s.text[at], j.lang[at]
            first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (lang[1:] != lang[:-1])]))
            last = np.append(first[1:], len(at)) - 1
            weight = j.s.letters[at].astype(np.float64)
            conf = np.add.reduceat(weight * j.confidence[at], first) / np.add.reduceat(weight, first)
            base = j.s.text_start[text[first]]
            start, stop = j.s.start[at[first]] - base, j.s.stop[at[last]] - base
            for k, t in enumerate(text[first].tolist()):
                if places[t] is not None:
                    start[k], stop[k] = places[t][start[k]], places[t][min(stop[k], len(places[t]) - 1)]
            cols = [chunk.column(0).take(pa.array(text[first])), pa.array(start), pa.array(stop), pa.array([LANGUAGES[k] for k in lang[first].tolist()]), pa.array(conf)]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "start", "stop", "lang", "confidence"])

    return map_batches(docs.select(docs[key], docs[text]), run, f"`{key}` {kind}, start bigint, stop bigint, lang string, confidence double")


def label_defects(docs: DataFrame, model: Model, key: str, text: str, label: str) -> DataFrame:
    """``key``, ``kind`` and ``lang`` of every text that is mixed (a row for each language), or whose label names no
    language (``missing``) or one that it isn't written in (``wrong``)."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, 1, size=1 << 20):
            main, whole, _, _ = Judged(shared.value, chunk.column(1).to_pylist()).per_text()
            kinds, place, langs = [], [], []
            for i, said in enumerate(chunk.column(2).to_pylist()):
                if main[i] < 0:
                    continue
                here = np.flatnonzero(whole[i]).tolist()
                if len(here) > 1:
                    what = [("mixed", LANGUAGES[k]) for k in here]
                else:
                    name, lang = named_language(said), LANGUAGES[main[i]]
                    what = [("missing", lang)] if name is None else [("wrong", lang)] if name != lang else []
                for k, lang in what:
                    place.append(i)
                    kinds.append(k)
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([chunk.column(0).take(pa.array(place, pa.int64())), pa.array(kinds, pa.string()), pa.array(langs, pa.string())], names=[key, "kind", "lang"])

    return map_batches(docs.select(docs[key], docs[text], docs[label]).where(F.col(key).isNotNull()), run, f"`{key}` {kind}, kind string, lang string").distinct()
