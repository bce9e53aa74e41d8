"""A change rewrites the buckets that it touches and no others."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.operators.maintain import BucketStore

SCHEMA = "md5 string, title string, isbn array<string>"


def rows(df):
    return sorted((r["md5"], r["title"], r["isbn"]) for r in df.collect())


def test_changes_touch_few_buckets(spark, tmp_path):
    store = BucketStore(spark, f"file://{tmp_path}/b", "md5", buckets=8)
    assert store.read() is None
    store.publish(spark.createDataFrame([(f"k{i}", f"t{i}", ["1"]) for i in range(100)], SCHEMA))
    before = store.load_state("current")["places"]
    touched = store.change(spark.createDataFrame([("k1",), ("k2",), ("nobody",)], "md5 string"), spark.createDataFrame([("k2", "new", []), ("k500", "more", None)], SCHEMA))
    after = store.load_state("current")["places"]
    assert 1 <= len(touched) <= 4 and {int(b) for b in before if before[b] != after[b]} == set(touched)
    wanted = sorted([(f"k{i}", f"t{i}", ["1"]) for i in range(100) if i not in (1, 2)] + [("k2", "new", []), ("k500", "more", None)], key=str)
    assert sorted(rows(store.read()), key=str) == wanted
    assert rows(store.of(spark.createDataFrame([("k2",), ("k9",), ("k1",)], "md5 string"))) == [("k2", "new", []), ("k9", "t9", ["1"])]
    # applied twice, a change gives the same
    store.change(spark.createDataFrame([("k1",)], "md5 string"), spark.createDataFrame([("k2", "new", [])], SCHEMA))
    assert sorted(rows(store.read()), key=str) == wanted
    assert store.change(None, spark.createDataFrame([], SCHEMA)) == []


def test_what_fails_changes_nothing(spark, tmp_path):
    store = BucketStore(spark, f"file://{tmp_path}/f", "md5", buckets=4)
    store.publish(spark.createDataFrame([("a", "x", None)], SCHEMA))
    with pytest.raises(Exception, match="broken"):
        store.change(None, spark.createDataFrame([("a", "y", None)], SCHEMA).withColumn("title", F.raise_error(F.lit("broken")).cast("string")))
    with pytest.raises(ValueError):
        store.publish(spark.createDataFrame([], SCHEMA), least_rows=1)
    assert rows(store.read()) == [("a", "x", None)]


def test_old_versions_go_once_no_list_names_them(spark, tmp_path):
    store = BucketStore(spark, f"file://{tmp_path}/o", "md5", buckets=2)
    for turn in range(4):
        store.publish(spark.createDataFrame([(f"k{i}", str(turn), None) for i in range(9)], SCHEMA))
    assert len(list((tmp_path / "o").glob("v-*"))) == 2
