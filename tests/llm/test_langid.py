"""Language ID against a plain version and by held-out accuracy."""

import zlib
from collections import Counter, defaultdict

import pytest
from cardlens.llm import langid
from corpora import corpus, documents, empty  # noqa: F401  fixtures


def grams(text):
    found, word = Counter(), ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
            continue
        if word:
            padded = f" {word} "
            for k in (1, 2, 3):
                found.update(padded[i:i + k] for i in range(len(padded) - k + 1))
        word = ""
    found.pop(" ", None)
    return found


def ranked(found, size):
    return sorted(found, key=lambda g: (-found[g], len(g), g))[:size]


def plain(rows, size):
    """{doc_id: (held_out, lang_pred, score)} of (doc_id, text, lang)."""
    held = {i: zlib.crc32(str("" if i is None else i).encode()) % 3 == 1 for i, _, _ in rows}
    totals = defaultdict(Counter)
    for i, text, lang in rows:
        if not held[i] and lang is not None and text is not None:
            totals[lang].update(grams(text))
    profiles = {lang: {g: r for r, g in enumerate(ranked(n, size))} for lang, n in totals.items() if n}
    out = {}
    for i, text, _ in rows:
        own = ranked(grams(text), size)
        far = [(sum(abs(p[g] - r) if g in p else size for r, g in enumerate(own)), lang) for lang, p in profiles.items()]
        out[i] = (held[i], "und", 0.0) if not own or not far else (held[i], min(far)[1], 1.0 - min(far)[0] / (size * len(own)))
    return out


ODD = ["", None, "12 34 !?", "a", "É", "İstanbul ẞ ΑΣ", "日本語 のテキスト", "\U00010400 x", "aaa aaa aaa", "ab " * 300, "don't e-mail", "x" * 300_000,
       "naïve\tcafé\nŽluťoučký kůň"]


def rows_of(corpus):
    langs = ["en", "fr", None, "de"]
    rows = [(i, t, langs[i % 4]) for i, t in corpus] + [(1000 + k, t, langs[k % 3]) for k, t in enumerate(ODD * 3)]
    return rows + [(None, "one two", "en")]


@pytest.mark.parametrize("size", [400, 7])
def test_predictions_equal_plain_version(spark, corpus, size):
    rows = rows_of(corpus)
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, lang string, gram string, score double").repartition(5)
    got = langid.predict_held_out(df, size).collect()
    assert {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in got} == plain(rows, size) and len(got) == len(rows)


def test_many_languages_take_further_passes(spark, corpus, monkeypatch):
    rows = rows_of(corpus)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = sorted(map(str, langid.predict_held_out(df).collect()))
    monkeypatch.setattr(langid, "LANGUAGES", 1)
    assert sorted(map(str, langid.predict_held_out(df).collect())) == whole


def test_counts_are_handed_on_and_added_up(spark, corpus, monkeypatch):
    df = spark.createDataFrame(rows_of(corpus), "doc_id long, text string, lang string")
    whole = sorted(langid.language_profiles(df).collect())
    monkeypatch.setattr(langid, "HELD", 50)
    assert sorted(langid.language_profiles(df).collect()) == whole


def test_repeated_rows_and_a_hot_language(spark):
    texts = [("the cat and the dog", "en")] * 400 + [("le chat et le chien", "fr")] * 3 + [("the and the", "en"), ("le et le", "fr")]
    df = spark.createDataFrame([(i // 2, t, x) for i, (t, x) in enumerate(texts)], "doc_id long, text string, lang string")
    got = {(r["lang"], r["lang_pred"]) for r in langid.predict_languages(df, langid.language_profiles(df)).collect()}
    assert got == {("en", "en"), ("fr", "fr")}


def test_nothing_to_learn(spark, empty):
    assert langid.predict_held_out(empty).collect() == []
    df = spark.createDataFrame([(i, "some words", None) for i in range(5)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in langid.predict_held_out(df).collect()} == {("und", 0.0)}


def test_gram_text():
    assert langid.gram_text(langid.BLANK << 42 | ord("t") << 21 | ord("h")) == "_th" and langid.gram_text(ord("é")) == "é"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict_held_out(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL")
    right, n = got.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert n > 200 and right >= 0.98 * n
