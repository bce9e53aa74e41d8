"""Searches of texts read and analyse them once, and what they sum up by document stays in bounded tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import search


def test_no_text_is_read_again_for_the_scores(spark, tmp_path):
    spark.createDataFrame([(1, "one two"), (2, "two tow"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/texts")
    docs, asked = spark.read.parquet(f"{tmp_path}/texts"), spark.createDataFrame([(7, "one twoo")], "query_id int, query string")
    found = search.cascade(docs, asked, {"text": F.col("text")})
    assert not any("/texts/" in f for f in found.inputFiles())
    assert [tuple(r)[:2] + (r["attempt"],) for r in found.collect()] == [(7, 1, 2)]


def test_tasks_grow_with_the_texts(spark):
    docs = spark.range(3).select(F.repeat(F.lit("é"), 50).alias("text"))
    assert search.tasks(docs, [F.col("text")], size=10) == 30


@pytest.mark.parametrize("text", ["Straße Æon 1²", "ß" * 19 + " x", "ß" * 20 + " x", "a" * 39 + " " + "B" * 40, "É" * 19 + "-" + "é" * 20, "İx Σας ǅ é"])
def test_texts_folded_whole_are_folded_alike(spark, text):
    tokens = F.regexp_extract_all(F.lit(text), F.lit(r"([\p{IsAlphabetic}\p{N}]+)"), 1)
    each = F.transform(F.filter(tokens, lambda t: F.octet_length(t) < T.TOKEN_BYTES), T.fold)
    row = spark.range(1).select(T.analyze(F.lit(text)).alias("a"), each.alias("b")).first()
    assert row["a"] == row["b"]
