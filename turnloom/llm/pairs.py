"""Broken replies: which of a pair's responses are of no use, and why.

For every reply one of

* ``empty``: null, nothing visible, or only a placeholder, mark-up, punctuation;
* ``refusal``: aligned with templates of declining (``refusals``);
* ``copy``: aligned with the prompt: the shingles of three tokens it shares with
  it, and where these leave it open the longest common subsequence of tokens, or
  of letters where words are misspelt: nothing but the prompt, perhaps slightly
  changed, framed or repeated;
* ``truncated``: breaks off inside a tool call, a list or a sentence; whether a
  reply without a final stop is whole is told by the sentences of all replies
  (``endings``);
* ``other_language``: in a language that the prompt neither uses nor asks for.

They are looked for in this order and the first one counts, so no reply has two.
Replies to a null prompt have no defect.  Complete tool calls have none.  Texts
of any length are aligned whole.  A key given twice counts once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.batches import text_chunks
from turnloom.llm.endings import Units, answered, questions
from turnloom.llm.langid import _BY_NAME, CLEAR, LANGUAGES, Judged, Model
from turnloom.llm.leak import folded, mixed
from turnloom.llm.refusals import is_refusal
from turnloom.session import map_batches

_OTHER = re.compile(r"[\W_]+")
_TAG = re.compile(r"<[^<>]*>|&[a-z]{2,6};|&#\d+;|!?\[[^\]]*\]\([^)]*\)")
_END = "。.!！?？；;"
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_LOW44 = _U((1 << 44) - 1)

# What stands where a reply is missing, and what it is made of.
_MISSING = re.compile(
    r"null|none|nil|nan|na|n/a|undefined|empty|blank|void|tb[acd]|todo|fixme|placeholder|"
    r"(?:no|missing|empty|blank|without|insert|your|enter|type|write|add)(?: an?| the| your| any)? (?:answer|response|reply|data|content|text|output|result|comment|message|value)s?(?: yet| available| given| provided| found| here)?|"
    r"(?:the )?(?:answer|response|reply|text|content|output)(?: is| was)? (?:missing|pending|empty|not (?:yet )?(?:available|given|provided|found)|(?:goes )?here|(?:will|to) (?:be )?(?:follow|come|added|provided|filled in))|"
    r"not (?:available|provided|answered|applicable|given|specified|filled in|yet answered)|(?:yet )?to be (?:added|determined|announced|completed|filled in|written|confirmed|done)|coming soon|fill (?:me )?in|lorem ipsum(?: [a-z ]+)?|"
    r"(?:暂|尚|目前|此处)?(?:无|没有|未有|缺|空)(?:任何|相关)?(?:回答|答案|回复|内容|数据|信息|答复|结果|记录|资料|文本|值)?|(?:暂|尚|目前)无(?:可用)?(?:回答|答案|回复|内容|数据)?|"
    r"(?:待|未|尚未|等待|有待|请|需)(?:补充|填写|回答|完善|回复|添加|更新|输入|定|处理|编辑|提供|填|补)(?:内容|答案|回答|回复|数据)?|(?:在)?此处?(?:填写|输入|插入|添加)(?:内容|答案|回答|回复|文本)?|"
    r"空白|省略|略|从略|同上|见上|见上文|如上|占位符?|なし|無し|未回答|未入力|回答なし|該当なし|sin respuesta|sans réponse|pas de réponse|aucune réponse|keine antwort|нет ответа|без ответа|нет данных"
)
#: More letters than the longest of them has, but for filler text; and any letter.
_MORE = re.compile(r"(?![\W_]*lorem\s+ipsum)(?:[\W_]*[^\W_]){41}", re.I)
_SOME = re.compile(r"[^\W_]")
_EDGES = " \t()（）[]【】{}<>\"'“”‘’「」.。*_-—~!！?？:：|/\\#`=+,，;；、"


def plain(text: str) -> str:
    """Lower-case letters and digits."""
    return _OTHER.sub("", text.lower())


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    if "<" in text or "&" in text or "](" in text:
        text = _TAG.sub(" ", text)
    if _MORE.match(text):
        return False
    if not _SOME.search(text):
        return True
    seen = "".join(" " if unicodedata.category(ch)[0] in "CZ" else ch for ch in text).strip(_EDGES).lower()
    return bool(_MISSING.fullmatch(" ".join(seen.replace("_", " ").split())))


_CALL = re.compile(r"^\s*Action\s*:", re.I)


def broken_call(text: str) -> bool | None:
    """Whether a tool call breaks off; None if the text is no tool call."""
    body = text.strip()
    if _CALL.match(body):
        head, found, rest = body.partition("Action Input:")
        if not found:
            return True
        raw = re.split(r"\n\s*(?:Action|Observation|Final Answer)\s*:", rest, maxsplit=1)[0].strip()
    elif body[:1] in "{[" and re.match(r'^[\[{]\s*["\[{]', body):
        raw = body
    else:
        return None
    try:
        json.loads(raw)
        return False
    except ValueError:
        return raw[:1] in "{[" or not raw

#: Tokens before the prompt that are its frame, and what may be new after it.
FRAME, NEW = 6, 3
#: Shares of the reply: shingles found in the prompt that decide, or leave it open; tokens found that leave it open; the
#: common subsequence that decides.
SURE, OPEN, LOOSE, COMMON = 0.9, 0.5, 0.75, 0.8


def common(a: Sequence, b: Sequence, *at: int) -> list[int]:
    """Lengths of the longest common subsequence of ``a`` with ``b``, and with its first ``at`` members; by bit vectors."""
    where: dict = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v, found = full, {}
    for k, x in enumerate(b):
        if k in at:
            found[k] = len(a) - v.bit_count()
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return [len(a) - v.bit_count(), *(found.get(k, len(a) - v.bit_count()) for k in at)]


def _aligned(p: Sequence, t: Sequence) -> bool:
    """Whether a reply is the prompt, once or again and again, with small changes and nothing new at its end."""
    again = list(p) * max(1, round(len(t) / len(p)))
    end = max(len(t) - max(2 * NEW, len(t) // 8), 0)
    both, before = common(again, t, end)
    return both >= COMMON * len(t) and both - before >= 0.5 * (len(t) - end)


class Tokens:
    """Tokens of texts one after another, with their text and the first of each text."""

    def __init__(self, hashes: np.ndarray, owner: np.ndarray, count: int):
        self.hash, self.owner = hashes, owner
        self.first = np.searchsorted(owner, np.arange(count + 1))

    def keys(self, n: int) -> np.ndarray:
        """Of every run of n tokens: its text and its hash; 0 where it crosses into another text."""
        m = max(len(self.hash) - n + 1, 0)
        h = np.zeros(m, _U)
        with np.errstate(over="ignore"):
            for j in range(n):
                h = h * _ODD + self.hash[j : j + m]
            key = self.owner[:m].astype(_U) + _U(1) << _U(44) | mixed(h) & _LOW44
        return np.where(self.owner[:m] == self.owner[n - 1 : n - 1 + m], key, _U(0))

    def digest(self) -> np.ndarray:
        """A hash of every text's tokens in order."""
        place = np.arange(len(self.hash)) - self.first[self.owner] if len(self.hash) else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            total = np.concatenate([[_U(0)], np.cumsum(mixed(self.hash + place.astype(_U) * _ODD), dtype=_U)])
            return total[self.first[1:]] - total[self.first[:-1]]

    def of(self, k: int) -> list[int]:
        return self.hash[self.first[k] : self.first[k + 1]].tolist()


def _shared(p: Tokens, t: Tokens, n: int) -> np.ndarray:
    """Of every token of the replies, whether a run of n tokens that begins there is in its prompt."""
    out = np.zeros(len(t.hash), bool)
    keys, known = t.keys(n), np.append(np.sort(p.keys(n)), _U(0))
    out[: len(keys)] = (keys != 0) & (known[np.searchsorted(known[:-1], keys)] == keys)
    return out


def _sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def copies(prompts: list[str], replies: list[str]) -> np.ndarray:
    """Which replies are copies of their prompts."""
    count = len(replies)
    a, b = Units(prompts), Units(replies)
    p, t = Tokens(a.hash, a.text, count), Tokens(b.hash, b.text, count)
    n, np_ = np.diff(t.first), np.diff(p.first)
    out = (n > 0) & (n == np_) & (p.digest() == t.digest())
    hit = _shared(p, t, 3)
    covered = hit.copy()
    covered[1:] |= hit[:-1]
    covered[2:] |= hit[:-2]
    place = np.arange(len(hit)) - t.first[t.owner] if len(hit) else np.zeros(0, np.int64)
    head, tail = np.full(count, 1 << 40), np.full(count, -1)
    np.minimum.at(head, t.owner[covered], place[covered])
    np.maximum.at(tail, t.owner[covered], place[covered])
    head = np.where(head <= FRAME, head, 0)
    tail = n - 1 - tail
    body = n - head
    share = _sum(hit, t.first) / np.maximum(body - 2, 1)
    left = body - _sum(covered, t.first)
    loose = _sum(_shared(p, t, 1), t.first) / np.maximum(body, 1)
    fits = (np_ >= 3) & (body >= 3) & (2 * body >= np_) & ~out
    ends = tail <= np.maximum(NEW, n // 25)
    out |= fits & (share >= SURE) & (left <= np.maximum(NEW, body // 12)) & ends
    for k in np.flatnonzero(fits & ~out & ((share >= OPEN) & ends | (loose >= LOOSE))).tolist():
        out[k] = _aligned(p.of(k), t.of(k)[head[k] :])
    # words with letters changed are other words: letters, where most tokens are words
    words = _sum(b.word, t.first) * 2 > n
    rest = np.flatnonzero(fits & ~out & words & (loose >= 0.2)).tolist()
    if rest:
        lp, lt = (Tokens(c[c > 0].astype(_U), o[c > 0], len(rest)) for c, o in (folded([x[k] for k in rest]) for x in (prompts, replies)))
        near = _sum(_shared(lp, lt, 3), lt.first) >= 0.45 * np.diff(lt.first)
        long, own = np.diff(lp.first), np.diff(lt.first)
        close = (long >= 8) & (2 * own >= long) & (2 * own <= 3 * long)
        for j in np.flatnonzero(near & close).tolist():
            out[rest[j]] = _aligned(lp.of(j), lt.of(j))
    return out


def is_copy(prompt: str, text: str) -> bool:
    return bool(copies([prompt], [text])[0])


_MARKER = re.compile(r"^\s*(?:[-*•]|\(?\d{1,3}[.)、）](?!\d))\s*$")
#: What a sentence cannot end with.
_OPEN_END = ("…", "..", "，", "、", ",", "：", ":", "；", ";", "（", "(", "「", "『", "“", "-", "–", "—")
_LAST_LINE_NUMBER = re.compile(r"(?:^|\n)\s*\d{1,3}\.$")
# How a wish or thanks after an answer begins.
_WISHES = ("祝", "谢谢", "多谢", "best wishes", "kind regards", "take care", "get well", "thanks", "thank you", "bon courage", "gute besserung", "alles gute", "que se mejore", "выздоравливайте", "お大事に")
_SMILE = re.compile(r"[:：;；=]['-]?[)）(（DPp]+$")
_LAST_STOP = re.compile(r".*[。！？!?~～\n]|.*\.(?=\s)", re.S)


def _symbol(ch: str) -> bool:
    return ch.isspace() or ch in "~～" or unicodedata.category(ch) in ("So", "Sk", "Cf", "Mn", "Me", "Cs", "Co", "Cn")


def body_of(text: str) -> str:
    """A reply without what follows its last sentence: symbols, a remark in brackets, a wish or thanks."""
    body = text
    while True:
        size = len(body)
        while body and not body[-1].isalnum() and _symbol(body[-1]):
            body = body[:-1]
        if body[-1:] in (")", "）"):
            smile = _SMILE.search(body[-6:])
            at = max(body.rfind("("), body.rfind("（"))
            if smile:
                body = body[: len(body) - len(smile.group())]
            elif at > 0:
                body = body[:at]
        elif body:
            m = _LAST_STOP.match(body, 0) if body[-1] not in "。！!.～~" else _LAST_STOP.match(body, 0, len(body) - 1)
            last = body[m.end() if m else 0 :].lstrip()
            if m and last.lower().startswith(_WISHES) and len(last) < len(body):
                body = body[: m.end()]
        if len(body) == size or not body:
            return body or text.rstrip()


def breaks_off(text: str) -> bool | str:
    """Whether a text breaks off, or what is left of it to ask the corpus about."""
    raw = text.rstrip()
    body = body_of(raw).rstrip()
    if not body:
        return False
    if raw.endswith(_OPEN_END) and not _SMILE.search(raw[-6:]) or body.endswith(_OPEN_END):
        return True
    if body[-1] in _END + "）)”\"'’」』】》>…`*|":
        return body[-1] == "." and bool(_LAST_LINE_NUMBER.search(body[-8:]))
    line = body.rsplit("\n", 1)[-1]
    if _MARKER.match(line):
        return True  # a list marker without its item
    if "\n" not in body and len(plain(body)) < 6:
        return False  # a few letters are a short answer
    return body


def is_truncated(text: str, replies: DataFrame, column: str) -> bool:
    """Of one text; ``broken_replies`` asks the corpus about all of them at once."""
    q = breaks_off(text)
    if isinstance(q, bool):
        return q
    ids = questions([q])[0]
    one = replies.sparkSession.createDataFrame([(_signed(ids),)], "question array<bigint>")
    return answered(one, replies, column).first().whole is False


def _signed(ids: list[int] | None) -> list[int] | None:
    return None if ids is None else [i - (1 << 64) if i >= 1 << 63 else i for i in ids]


# Words that ask for a reply in a language, after or before its name.
_ASKS = re.compile(r"译|翻|用|以|说|讲|写成|回答|translat|in |into |auf |ins |en |au |на |по-|で|に", re.I)
_NAMES = re.compile("|".join(sorted(map(re.escape, (n for n in _BY_NAME if len(n) > 3 or not n.isascii())), key=len, reverse=True)), re.I)


def asked_languages(prompt: str) -> set[str]:
    return {_BY_NAME[m.group().lower()] for m in _NAMES.finditer(prompt)} if _ASKS.search(prompt) else set()


def surely_chinese(texts: list[str]) -> np.ndarray:
    """Texts of Chinese characters, at most a tenth of other letters, and no kana: no closer look at their language."""
    codes, owner = folded(texts)
    wide, kana = (codes >= 0x3400) & (codes < 0xA000) | (codes >= 0x20000), (codes >= 0x3040) & (codes < 0x3100) | (codes >= 0xFF66) & (codes < 0xFFA0)
    letter = (codes > 0) & ~((codes >= 48) & (codes < 58))
    a, b, c = (np.bincount(owner[x], minlength=len(texts)) for x in (wide, kana, letter))
    return (a >= 4) & (b == 0) & (10 * a >= 9 * c)


def defects(prompts: list[str | None], replies: list[str | None], model: Model) -> tuple[list[str | None], list[list[int] | None]]:
    """The defect of each reply, None if it has none; and what the corpus is to be asked about its ending, None where
    that is certain.  If the answer is that it isn't whole, the reply is ``truncated`` instead."""
    out: list[str | None] = [None] * len(replies)
    asked: list[list[int] | None] = [None] * len(replies)
    prose: list[int] = []
    for k, (p, r) in enumerate(zip(prompts, replies, strict=True)):
        if p is None:
            continue
        if is_empty(r):
            out[k] = "empty"
        elif (call := broken_call(r)) is not None:
            out[k] = "truncated" if call else None
        elif is_refusal(r):
            out[k] = "refusal"
        else:
            prose.append(k)
    if not prose:
        return out, asked
    copied = copies([prompts[k] for k in prose], [replies[k] for k in prose]).tolist()
    rest, bodies = [], []
    for k, copy in zip(prose, copied, strict=True):
        if copy:
            out[k] = "copy"
        elif (q := breaks_off(replies[k])) is True:
            out[k] = "truncated"
        else:
            rest.append(k)
            bodies.append(q)
    ask = [j for j, q in enumerate(bodies) if q]
    for j, ids in zip(ask, questions([bodies[j] for j in ask]), strict=True):
        asked[rest[j]] = _signed(ids)
    both = surely_chinese([prompts[k] for k in rest]) & surely_chinese([replies[k] for k in rest]) if rest else np.zeros(0, bool)
    rest = [k for k, same in zip(rest, both.tolist(), strict=True) if not same]
    if rest:
        prompt, reply = Judged(model, [prompts[k] for k in rest]), Judged(model, [replies[k] for k in rest])
        (pm, pw, _, _), (rm, *_) = prompt.per_text(least=4), reply.per_text()
        for i, k in enumerate(rest):
            lang = int(rm[i])
            if lang < 0 or pm[i] < 0 or lang == pm[i] or pw[i, lang] or reply.nearness[i, lang] < CLEAR * reply.nearness[i, pm[i]]:
                continue
            if prompt.nearness[i, lang] * CLEAR >= prompt.nearness[i, pm[i]]:
                continue  # the prompt is too short to tell
            if LANGUAGES[lang] not in asked_languages(prompts[k]):
                out[k] = "other_language"
    return out, asked


def each_once(replies: DataFrame, key: str, text: str) -> DataFrame:
    """The replies that the endings are counted in: of a key, equal texts count once."""
    return replies.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text).distinct().select(text)


def broken_replies(pairs: DataFrame, model: Model, key: str = "rec_id", prompt: str = "prompt", reply: str = "reply", field: str = "fld", corpus: DataFrame | None = None) -> DataFrame:
    """``key``, ``field`` and ``defect`` of every reply with a defect.  ``corpus``: the texts in a column ``reply`` whose
    sentences say how sentences end; those of ``pairs``, if not given."""
    kind = pairs.schema[key].dataType.simpleString()
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, 2, 3, size=1 << 20):
            found, asked = defects(chunk.column(2).to_pylist(), chunk.column(3).to_pylist(), shared.value)
            at = [k for k, d in enumerate(found) if d or asked[k]]
            place = pa.array(at, pa.int64())
            cols = [chunk.column(0).take(place), chunk.column(1).take(place), pa.array([found[k] for k in at], pa.string()), pa.array([asked[k] for k in at], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[key, field, "defect", "question"])

    rows = pairs.select(key, field, prompt, reply).where(F.col(key).isNotNull() & F.col(prompt).isNotNull())
    found = map_batches(rows, run, f"`{key}` {kind}, `{field}` string, defect string, question array<bigint>")
    texts = each_once(pairs, key, reply).withColumnRenamed(reply, "reply") if corpus is None else corpus
    told = answered(found, texts, "reply")
    return told.select(key, field, F.when(~F.col("whole"), "truncated").otherwise(F.col("defect")).alias("defect")).where("defect is not null").distinct()
