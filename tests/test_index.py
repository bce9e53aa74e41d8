"""The stored index gives what a search of the texts gives, at any time of its life."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import index as I
from lectern.operators import search

def fields() -> dict:
    return {"title": F.col("title"), "note": F.col("note")}


SCHEMA = "doc_id string, title string, note string, lang string"


def docs_of(rng: random.Random, ids: range) -> list[tuple]:
    word = lambda: "w" + "abcdefgh"[min(7, int(rng.expovariate(0.5)))] * rng.randint(1, 3)
    return [(f"d{i}", " ".join(word() for _ in range(rng.randint(0, 6))), None if rng.random() < 0.2 else " ".join(word() for _ in range(rng.randint(0, 30))), rng.choice(["en", "de"])) for i in ids]


QUERIES = [(1, "waa wb"), (2, "wbb wc waaa"), (3, "wx waa"), (4, "wzzzz"), (5, "waq wbbb"), (6, "wa wb wc wd we wf wg wh"), (7, "hwa wbb"), (8, "")]


def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id int, query string")


def same(index, docs, spark, boosts, whole=False):
    q, in_de = asked(spark), docs.where("lang = 'de'")
    for every in (True, False)[not whole :]:
        assert sorted(map(tuple, index.bm25(q, every).collect())) == sorted(map(tuple, search.bm25(docs, q, fields(), every, boosts).collect()))
    for where in (None, F.col("lang") == "de")[not whole :]:
        wanted = search.cascade(docs, q, fields(), boosts, ("title",), where)
        found = index.cascade(q, where=None if where is None else in_de)
        assert sorted(map(tuple, found.select(wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))


def test_index_through_changes_and_merges(spark, tmp_path):
    rng, boosts = random.Random(3), {"title": 3.0, "note": 0.5}
    index = I.Index(spark, f"file://{tmp_path}/i", fields(), boosts=boosts, fuzzy_fields=("title",), block=8, buckets=4)
    rows = {r[0]: r for r in docs_of(rng, range(150))}
    frame = lambda rs: spark.createDataFrame(list(rs), SCHEMA)
    index.build(frame(rows.values()))
    same(index, frame(rows.values()), spark, boosts, whole=True)
    for turn in range(4):
        # some documents are replaced, some removed, some are new; at the end one batch only removes
        new = {r[0]: r for r in docs_of(rng, range(140 + 10 * turn, 155 + 10 * turn))} if turn < 3 else {}
        gone = [k for k in rows if k in new or rng.random() < (0.01 if turn < 3 else 0.05)]
        index.apply(frame(rows[k] for k in gone), frame(new.values()))
        rows = {k: r for k, r in rows.items() if k not in gone} | new
        assert index.documents() == len(rows)
    assert len(index.segments()) == 5
    same(index, frame(rows.values()), spark, boosts)
    # the small segments are joined, the first one stays as it is
    first = index.segments()[0]["name"]
    assert index.merge(frame(rows.values())) == 2 and index.segments()[0]["name"] == first
    same(index, frame(rows.values()), spark, boosts)
    gone = list(rows)[:60]
    index.apply(frame(rows[k] for k in gone), frame([]))
    rows = {k: r for k, r in rows.items() if k not in gone}
    assert index.merge(frame(rows.values())) == 1 and index.documents() == len(rows)
    # of what is no longer current, only the last list's segments are left
    folders = {p.name for p in (tmp_path / "i").iterdir() if p.name.startswith("segment")}
    assert {s["name"] for s in index.segments()} <= folders and len(folders) <= 5


def test_threshold_skips_blocks_and_loses_no_hit(spark, tmp_path):
    rng = random.Random(9)
    rare = [(f"r{i}", "needle " * (1 + i % 3) + "common", None, "en") for i in range(50)]
    rows = rare + [(f"c{i}", "common " * rng.randint(1, 3) + "filler " * rng.randint(5, 30), None, "en") for i in range(900)]
    docs, q = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, "needle common")], "query_id int, query string")
    index = I.Index(spark, f"file://{tmp_path}/t", fields(), block=8)
    index.build(docs)
    report: dict = {}
    found = sorted(map(tuple, index.bm25(q, False, report=report).collect()))
    assert found == sorted(map(tuple, search.bm25(docs, q, fields(), False).collect())) and len(found) == 40
    assert report["read"] < 0.7 * report["postings"] and report["opened"] < report["blocks"]


def test_few_terms_prune_folders_and_row_groups(spark, tmp_path):
    index = I.Index(spark, f"file://{tmp_path}/p", fields(), buckets=8)
    index.build(spark.createDataFrame(docs_of(random.Random(1), range(60)), SCHEMA))
    plan = index._of("postings", spark.createDataFrame([("waa",)], "token string"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "EqualTo(token,waa)" in plan or "In(token" in plan


def test_an_error_leaves_the_index_as_it_was(spark, tmp_path):
    index = I.Index(spark, f"file://{tmp_path}/e", fields())
    index.build(spark.createDataFrame(docs_of(random.Random(2), range(20)), SCHEMA))
    before = index.segments()
    bad = spark.createDataFrame([("x", "a b", None, "en")], SCHEMA).withColumn("title", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        index.apply(bad.limit(0), bad)
    assert index.segments() == before and index.documents() == 20


def test_an_index_without_documents(spark, tmp_path):
    index = I.Index(spark, f"file://{tmp_path}/n", fields())
    index.build(spark.createDataFrame([], SCHEMA))
    assert index.documents() == 0 and index.cascade(asked(spark)).collect() == [] and index.bm25(asked(spark), False).collect() == []
    with pytest.raises(LookupError):
        I.Index(spark, f"file://{tmp_path}/none", fields()).vocabulary()
