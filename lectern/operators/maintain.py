"""Keeping a table of books current: replace, upsert, delete, and publishing versions."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def replace_source(books: DataFrame, new: DataFrame, source: str) -> DataFrame:
    return books.where(F.col("source") != source).unionByName(new)


def delete_keys(books: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return books.join(keys.select(F.lower(key).alias(key)).distinct(), key, "left_anti").select(*books.columns)


def upsert(books: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return delete_keys(books, new, key).unionByName(new)


def apply_changes(books: DataFrame, removals: DataFrame, upserts: DataFrame, key: str) -> DataFrame:
    """Removals first, then upserts: a key in both ends up present. Applying twice changes nothing more."""
    return upsert(delete_keys(books, removals, key), upserts, key)


class Store:
    """Versions of a table in a folder of any file system that Spark reaches.

    A version is written beside the others and becomes current when a small
    pointer file with a greater number than the last takes its name, by one
    rename; nothing that readers may look at is ever taken away before. They see
    the old or the new version, whole. The version before the current one stays
    for those who still read it; older ones are removed.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def _pointers(self, name: str) -> list[str]:
        """File names of a state, the newest last."""
        found = self._fs().globStatus(self._path(f"{name}.[0-9]*.json")) or []
        return sorted(s.getPath().getName() for s in found)

    def load_state(self, name: str = "state") -> dict:
        found = self._pointers(name)
        return json.loads(self.spark.read.text(f"{self.folder}/{found[-1]}", wholetext=True).first()[0]) if found else {}

    def save_state(self, state: dict, name: str = "state") -> None:
        fs, aside = self._fs(), self._path(f".{name}-{time.time_ns()}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        before = self._pointers(name)
        number = max(time.time_ns(), int(before[-1].split(".")[-2]) + 1) if before else time.time_ns()
        if not fs.rename(aside, self._path(f"{name}.{number:020d}.json")):
            raise OSError(f"{name} could not be saved in {self.folder}")
        for old in before[:-1]:
            fs.delete(self._path(old), False)

    def publish(self, books: DataFrame, least_rows: int | None = None) -> str:
        """Writes a version; if it has not the rows that it should, the current one stays."""
        version = f"v-{time.time_ns()}"
        books.write.parquet(f"{self.folder}/{version}")
        rows = self.spark.read.parquet(f"{self.folder}/{version}").count()
        if least_rows is not None and rows < least_rows:
            self._fs().delete(self._path(version), True)
            raise ValueError(f"{rows} rows written, {least_rows} expected; the current version stays")
        last = self.load_state("current").get("version")
        self.save_state({"version": version, "rows": rows}, "current")
        for status in self._fs().globStatus(self._path("v-*")) or []:
            if status.getPath().getName() not in (version, last):
                self._fs().delete(status.getPath(), True)
        return version

    def read(self) -> DataFrame | None:
        current = self.load_state("current")
        return self.spark.read.parquet(f"{self.folder}/{current['version']}") if current else None


class BucketStore(Store):
    """A table in buckets of its key's hash, of which a change rewrites only those that it touches.

    The pointer file lists each bucket's folder; new folders of touched buckets
    and the old ones of all others become current together. A bucket's rows are
    one task's work, so there should be enough buckets for that.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 64):
        super().__init__(spark, folder)
        self.key, self.buckets = key, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _put(self, rows: DataFrame, touched: list[int], before: dict) -> dict:
        version = f"v-{time.time_ns()}"
        rows.select("*", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{version}")
        places = before.get("places", {}) | {str(b): version for b in touched}
        state = {"places": places, "schema": rows.schema.json(), "version": version}
        self.save_state(state, "current")
        # what neither this nor the last list names goes
        named = {*places.values(), *before.get("places", {}).values()}
        for status in self._fs().globStatus(self._path("v-*")) or []:
            if status.getPath().getName() not in named:
                self._fs().delete(status.getPath(), True)
        return state

    def _rows(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        paths = [f"{self.folder}/{v}/bucket={b}" for b, v in state["places"].items() if buckets is None or int(b) in buckets]
        # a bucket without rows has no folder
        paths = [p for p in paths if self._path("x").getFileSystem(self._conf).exists(self._jvm.org.apache.hadoop.fs.Path(p))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        current = self.load_state("current")
        return self._rows(current) if current else None

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys; other buckets aren't read."""
        current = self.load_state("current")
        touched = self._touched(keys)
        return self._rows(current, touched).join(keys.select(self.key).distinct(), self.key, "left_semi").select(*json_names(current["schema"]))

    def _touched(self, keys: DataFrame) -> list[int]:
        return [r[0] for r in keys.select(self._bucket()).distinct().collect()]  # no more than there are buckets

    def publish(self, books: DataFrame, least_rows: int | None = None) -> str:
        """The whole table anew; if it has not the rows that it should, the current one stays."""
        if least_rows is not None and (rows := books.count()) < least_rows:
            raise ValueError(f"{rows} rows, {least_rows} expected; the current version stays")
        return self._put(books, list(range(self.buckets)), {"places": self.load_state("current").get("places", {})})["version"]

    def change(self, removals: DataFrame | None, upserts: DataFrame) -> list[int]:
        """Removals first, then upserts (one row a key): rewrites the buckets that they touch, and returns these."""
        current = self.load_state("current")
        if not current:
            self.publish(upserts)
            return list(range(self.buckets))
        keys = upserts.select(self.key) if removals is None else upserts.select(self.key).unionByName(removals.select(self.key))
        touched = self._touched(keys)
        if touched:
            kept = self._rows(current, touched).join(keys.distinct(), self.key, "left_anti").select(*upserts.columns)
            self._put(kept.unionByName(upserts), touched, current)
        return touched


def json_names(schema: str) -> list[str]:
    return StructType.fromJson(json.loads(schema)).names
