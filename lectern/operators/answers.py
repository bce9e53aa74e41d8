"""A model's answers, kept: asked once for each query and subject, and not while the model fails."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.maintain import BucketStore
from lectern.operators.stage import frozen

#: Seconds without questions after a failure.
BACK_OFF = 30.0


class Answers:
    """ask: (requests with ``key``, seconds left) to (key, relevance, genuine), null or absent where the model didn't answer in time.

    The answers lie in a table by key; a batch reads and rewrites only the buckets
    of its keys, and only its misses are asked. A failure, or an answer that didn't
    come in time, stops all questions for a while; what was answered before is
    still told, and rows without an answer keep the heuristic."""

    def __init__(self, spark: SparkSession, folder: str, ask: Callable[[DataFrame, float], DataFrame], back_off: float = BACK_OFF, clock: Callable[[], float] = time.time):
        self.store, self.ask, self.back_off, self.clock = BucketStore(spark, folder, "key", buckets=16), ask, back_off, clock

    @staticmethod
    def key(query: Column, subject: Column) -> Column:
        """Of a query's text and what it is asked about: a file's md5, or a work's key."""
        return F.sha2(F.concat_ws("␟", query, subject), 256)

    def backing_off(self) -> bool:
        return self.clock() < self.store.load_state("back_off").get("until", 0.0)

    def failed(self) -> None:
        if not self.backing_off():
            self.store.save_state({"until": self.clock() + self.back_off}, "back_off")

    def of(self, requests: DataFrame, seconds: float = 10.0) -> DataFrame:
        """The requests (key and others) with relevance and genuine, null without an answer."""
        requests, answers = frozen(requests), None
        if self.store.load_state("current"):
            answers = frozen(self.store.of(requests.select("key")))
        misses = requests if answers is None else requests.join(answers.select("key"), "key", "left_anti")
        misses = frozen(misses.dropDuplicates(["key"]))
        if not self.backing_off() and not misses.isEmpty():
            try:
                told = self.ask(misses, seconds).select("key", F.col("relevance").cast("double").alias("relevance"), F.col("genuine").cast("double").alias("genuine"))
                given = frozen(told.where("relevance is not null").dropDuplicates(["key"]))
            except Exception:  # noqa: BLE001  whatever the model's failure is, the heuristic stands in for it
                self.failed()
            else:
                if not misses.select("key").join(given.select("key"), "key", "left_anti").isEmpty():
                    self.failed()
                self.store.change(None, given)
                answers = given if answers is None else answers.unionByName(given)
        if answers is None:
            return requests.withColumns({"relevance": F.lit(None).cast("double"), "genuine": F.lit(None).cast("double")})
        return requests.join(answers, "key", "left")
