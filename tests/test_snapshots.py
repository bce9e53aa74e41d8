"""The newest snapshot is taken whole or not at all."""

from __future__ import annotations

import pytest

from lectern.sources import discovery


def listing(spark, *rows):
    return spark.createDataFrame(list(rows), "mirror string, name string")


def test_mirrors_add_to_each_other(spark):
    found = discovery.newest_volumes(listing(
        spark, ("b", "d_2024-02-01.part01.rar"), ("a", "d_2024-02-01.part02.rar"), ("a", "d_2024-02-01.part01.rar"), ("b", "d_2024-02-01.part03.rar"), ("a", "d_2024-01-01.part01.rar"), ("a", "readme")))
    assert [tuple(r) for r in found.orderBy("volume").collect()] == [("2024-02-01", k, m, f"d_2024-02-01.part0{k}.rar") for k, m in ((1, "a"), (2, "a"), (3, "b"))]


def test_one_volume_without_a_number(spark):
    assert [r["volume"] for r in discovery.newest_volumes(listing(spark, ("a", "d_2024-02-01.rar"))).collect()] == [1]


@pytest.mark.parametrize("names", [[], ["readme"], ["d_2024-01-01.rar", "d_2024-02-01.part02.rar"], ["d_2024-02-01.part01.rar", "d_2024-02-01.part03.rar"], ["d_2024-02-01.part00.rar"]])
def test_no_older_snapshot_in_place_of_an_incomplete_one(spark, names):
    with pytest.raises(discovery.SnapshotError):
        discovery.newest_volumes(listing(spark, *[("a", n) for n in names]))


def test_a_listing_is_read_once(spark, tmp_path):
    listing(spark, ("b", "d_2024-02-01.part01.rar"), ("a", "d_2024-02-01.part01.rar"), ("a", "d_2024-01-01.rar")).write.parquet(f"{tmp_path}/listing")
    found = discovery.newest_volumes(spark.read.parquet(f"{tmp_path}/listing"))
    assert not any("/listing/" in f for f in found.inputFiles()) and [r["mirror"] for r in found.collect()] == ["a"]
