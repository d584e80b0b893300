import random
import unicodedata

import pytest

from turnloom.llm.langid import LANGUAGES, composed_places, document_languages, fit, fit_languages, label_defects, language_segments, named_language, prose


@pytest.fixture(scope="module")
def model(spark, sf):
    return fit_languages(spark.read.parquet(f"{sf}/lang_reference.parquet"))


def test_labels():
    for label, want in [("EN", "en"), ("en_GB", "en"), ("zh_Hans", "zh"), ("中文", "zh"), ("deu", "de"), ("Français", "fr"), ("japanese", "ja"), ("ru-RU", "ru"), (" es-MX ", "es")]:
        assert named_language(label) == want
    for label in (None, "", " ", "-", "und", "xx", "n/a", "unknown", "UNK"):
        assert named_language(label) is None


def test_held_out_accuracy(spark, sf):
    """Fitted on two thirds of the samples, right on all others."""
    rows = sorted((r.lang, r.text) for r in spark.read.parquet(f"{sf}/lang_reference.parquet").collect())
    model = fit([r for k, r in enumerate(rows) if k % 3])
    held = spark.createDataFrame([(k, r[1], r[0]) for k, r in enumerate(rows) if not k % 3], "id bigint, text string, want string")
    got = {r.id: r.lang for r in document_languages(held, model, "id", "text").collect()}
    assert all(got[r.id] == r.want for r in held.collect())


SENTENCES = {
    "en": "The clerks of the old harbour surveyed the granary before the winter came.", "zh": "入秋以后，门诊里过敏性鼻炎病人增加了很多，需要注意保暖。", "fr": "La vieille infirmière a retrouvé les cahiers déchirés avant de partir.",
    "de": "Der Wächter am Hafen kaufte eine Schachtel Pflaster und auch ein altes Rezept.", "es": "La vendedora de verduras perdió unas cuantas monedas y también una receta.", "ru": "Старая медсестра проверяет самый надёжный путь, так как дверь закрыта.",
    "ja": "去年の冬から、隣の子どもが病院の予約を忘れてしまったそうです。",
}


def test_defects(spark, model):
    assert set(SENTENCES) == set(LANGUAGES)
    rows = [(k, SENTENCES[lang] * 2, lang) for k, lang in enumerate(LANGUAGES)]
    rows += [
        (20, SENTENCES["en"], "de"), (21, SENTENCES["fr"], None), (22, SENTENCES["zh"] + " " + SENTENCES["ru"], "zh"), (23, "short", None), (24, None, None), (25, "", "en"),
        (26, SENTENCES["zh"] + "（见 Lanangfrayby 与 “evidence level 92” 一栏）", "zh"), (27, 'human: ' + SENTENCES["zh"] + '\nfunction_call: {"name": "drug_lookup", "arguments": {"drug_name": "a very long english value here"}}', "zh"),
        (28, "Тhе сlеrks оf thе оld hаrbоur surveyed the granary before the winter came.", "en"), (20, SENTENCES["en"], "de"), (None, SENTENCES["en"], "de"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, text string, label string, kind string")
    got = sorted(tuple(r) for r in label_defects(df, model, "id", "text", "label").collect())
    assert got == [(20, "wrong", "en"), (21, "missing", "fr"), (22, "mixed", "ru"), (22, "mixed", "zh")]
    assert label_defects(df.limit(0), model, "id", "text", "label").count() == 0


def test_segments(spark, model):
    text = SENTENCES["en"] + " " + SENTENCES["de"] + " " + SENTENCES["de"] + "\n" + SENTENCES["ja"]
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id bigint, text string")
    got = sorted(tuple(r) for r in language_segments(df, model, "id", "text").collect())
    assert [g[3] for g in got] == ["en", "de", "ja"] and all(0.5 < g[4] <= 1 for g in got)
    assert text[got[1][1] : got[1][2]].strip().startswith("Der Wächter") and got[2][2] == len(text)


def test_languages_have_a_row_for_each_row(spark, model):
    df = spark.createDataFrame([(1, SENTENCES["ru"]), (2, None), (3, "12345"), (1, SENTENCES["ru"])], "id bigint, text string")
    got = sorted((r.id, r.lang) for r in document_languages(df, model, "id", "text").collect())
    assert got == [(1, "ru"), (1, "ru"), (2, None), (3, None)]


def test_json_ends_at_its_own_brace():
    t = 'see {"a": {"b": "x}"}, "c": [1]} and then a sentence, [{"d": 1}] more } here { open'
    got = prose(t)
    assert len(got) == len(t) and "and then a sentence," in got and "more } here { open" in got and '"' not in got


def test_prose_keeps_places():
    t = 'a {"x": 1} b `code` <tag> c'
    assert len(prose(t)) == len(t) and "code" not in prose(t) and prose(t).endswith(" c")


def test_without_samples(spark, sf):
    empty = fit_languages(spark.read.parquet(f"{sf}/lang_reference.parquet").limit(0))
    df = spark.createDataFrame([(1, SENTENCES["en"])], "id bigint, text string")
    assert document_languages(df, empty, "id", "text").first().lang is None
    one = fit([("en", SENTENCES["en"])])
    assert document_languages(df, one, "id", "text").first().lang == "en"


def test_segments_of_joined_samples(spark, sf):
    """Held-out samples of two or three languages joined: share of their letters that come out in their language, and
    share of the letters of found segments that are right."""
    rows = sorted((r.lang, r.text) for r in spark.read.parquet(f"{sf}/lang_reference.parquet").collect())
    model, held = fit([r for k, r in enumerate(rows) if k % 3]), [r for k, r in enumerate(rows) if not k % 3]
    rng = random.Random(5)
    texts, truth = [], []
    for _ in range(150):
        some = rng.sample(held, rng.choice([2, 3]))
        text, spans = "", []
        for lang, t in some:
            spans.append((len(text), len(text) + len(t), lang))
            text += t + rng.choice(["\n", " ", "\n\n"])
        texts.append(text)
        truth.append(spans)
    for form in ("NFC", "NFD"):
        df = spark.createDataFrame([(k, unicodedata.normalize(form, t)) for k, t in enumerate(texts)], "id bigint, text string")
        found: dict[int, list] = {}
        for r in language_segments(df, model, "id", "text").collect():
            found.setdefault(r.id, []).append(r)
        right = planted = told = 0
        for k, t in enumerate(texts):
            own = unicodedata.normalize(form, t)
            of = [""] * len(own)
            for a, b, lang in truth[k]:
                a, b = (len(unicodedata.normalize(form, t[:x])) for x in (a, b))
                of[a:b] = [lang] * (b - a)
            got = [""] * len(own)
            for r in found.get(k, []):
                got[r.start : r.stop] = [r.lang] * (r.stop - r.start)
            letters = [i for i, ch in enumerate(own) if ch.isalpha() and of[i]]
            planted += len(letters)
            told += sum(got[i] != "" for i in letters)
            right += sum(got[i] == of[i] for i in letters)
        assert right >= 0.9 * planted and right >= 0.95 * told, (form, right / planted, right / told)


def test_composed_places():
    assert composed_places("abc")[1] is None
    text, places = composed_places("ae\u0301b\u3042")
    assert text == "a\u00e9b\u3042" and places.tolist() == [0, 1, 3, 4, 5]
