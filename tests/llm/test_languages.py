"""Every language that occurs is told apart."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lectern.llm import langid


def test_more_languages_than_a_group(spark):
    n = langid.WHOLE_TABLE + 6
    letters = "abcdefghijklmnopqrstuvwxyz"
    codes = [a + b for a in letters for b in letters][:n]
    rows = []
    for k, code in enumerate(codes):
        rng = random.Random(k)
        words = ["".join(rng.choices(letters, k=6)) for _ in range(12)]
        # the last languages have fewer texts than the others
        rows += [(100 * k + i, " ".join(rng.choices(words, k=40)), code, code) for i in range(3 if k < langid.WHOLE_TABLE else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    pages = spark.createDataFrame([(1, "http://x.example.com/" + codes[-1] + "/1", "<html lang='" + codes[-1] + "'>" + rows[-1][1])], "page_id long, url string, html string")
    got = langid.op7(docs, pages).collect()
    truth = {r[0]: r[2] for r in rows}
    assert [r["doc_id"] for r in got if r["table"] == "documents" and r["lang"] != truth[r["doc_id"]]] == []
    assert [(r["lang"], r["text_lang"]) for r in got if r["table"] == "pages"] == [(codes[-1], codes[-1])]


def test_table_and_lookup_are_equal(monkeypatch):
    rng = np.random.default_rng(3)
    n = 30
    cell = np.unique(rng.integers(0, n * langid.BUCKETS, 40_000))
    lang, bucket, often = cell // langid.BUCKETS, cell % langid.BUCKETS, rng.integers(1, 50, len(cell))
    data = rng.integers(97, 123, 9_000).astype(np.uint8)
    at = np.array([0, 0, 2, 700, 701, 5_000, 9_000, 9_000])
    names = [f"{k:02d}" for k in range(n)]
    want = langid.TextModel(names, lang, bucket, often).likelihoods(data, at)
    monkeypatch.setattr(langid, "WHOLE_TABLE", 0)
    for block in (1, 977, 2_000_000):
        monkeypatch.setattr(langid, "BLOCK", block)
        np.testing.assert_allclose(langid.TextModel(names, lang, bucket, often).likelihoods(data, at), want, rtol=1e-12)
    assert np.isclose(want[0], 0).all() and langid.TextModel(names, lang, bucket, often).likelihoods(data[:0], np.array([0])).shape == (0, n)


@pytest.mark.parametrize("n", [600, 5_000])
def test_many_languages(spark, n):
    """Each language has three texts and a word of its own in them."""
    rng = random.Random(n)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(n):
        words = ["".join(rng.choices(letters, k=6)) for _ in range(12)]
        rows += [(3 * k + i, " ".join(rng.choices(words, k=40)), f"l{k}", f"s{k % 7}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(8)
    pages = spark.createDataFrame([(1, "http://x.example.com/", "<p>" + rows[5][1])], "page_id long, url string, html string")
    got = langid.op7(docs, pages).collect()
    assert len(got) == 3 * n + 1
    truth = {r[0]: r[2] for r in rows} | {None: "l1"}
    assert [r["doc_id"] for r in got if r["lang"] != truth[r["doc_id"]]] == []


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([(str(k), "some text") for k in range(3)], "lang string, text string")
    with pytest.raises(ValueError, match="languages"):
        langid.text_model(docs)
