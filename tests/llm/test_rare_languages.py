"""Rare languages and texts without one are held against a fitting reference."""

from __future__ import annotations

import random

import pytest

from lectern.llm import quality

CYRILLIC = "и в не на что он как это она но за весь год человек время рука дело раз стать жизнь день голова вопрос друг сторона мир случай".split()


def cyrillic(seed, n=120):
    rng = random.Random(seed)
    weights = [1 / (k + 1) for k in range(len(CYRILLIC))]
    return " ".join(rng.choices(CYRILLIC, weights, k=n)) + "."


def kept(spark, docs, rows):
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.op9(docs.select("doc_id", "text", "lang").union(more)).where("doc_id >= 1000000").collect()
    return {r["doc_id"] - 1000000: r["kept"] for r in got if not r["base_failed"]}


@pytest.mark.parametrize("n", [1, 49])
def test_rare_language(spark, sf_dir, n):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = kept(spark, docs, [(1000000 + i, cyrillic(i), "ru") for i in range(n)] + [(1000100 + i, cyrillic(100 + i), None) for i in range(5)])
    wanted = [got[k] for k in got if k < 100]
    assert wanted and all(wanted)
    if n > 1:
        assert all(got[k] for k in got if k >= 100) and any(k >= 100 for k in got)


def test_junk_without_language_fails(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(1)
    junk = " ".join("".join(rng.choices("#*$%&|<>0123456789", k=8)) for _ in range(200))
    assert kept(spark, docs, [(1000000, junk, None)]) == {0: False}
