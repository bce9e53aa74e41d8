"""Incremental updates: classifying changes, keyset windows, replaying days, and a stream of upserts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.stage import EXTENSIONS, frozen
from lectern.session import ship

MOST_EMPTY = 4
CATCH_UP_DAYS = 7
#: Steps between keyset windows that one task may pass over.
WALKED = 1_000_000


def classify(changes: DataFrame, known: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Adds ``change`` to (md5, visible, broken, extension): ignored, removal, unchanged or new."""
    marked = changes.withColumn("md5", F.lower(F.coalesce("md5", F.lit("")))).join(known.select(F.lower("md5").alias("md5"), F.lit(True).alias("_known")).distinct(), "md5", "left")
    gone = (F.coalesce("visible", F.lit("")) != "") | (F.coalesce("broken", F.lit("")) == "Y") | ~F.lower(F.coalesce("extension", F.lit(""))).isin(*extensions)
    return marked.withColumn("change", F.when(F.octet_length("md5") != 32, "ignored").when(gone, "removal").when(F.col("_known"), "unchanged").otherwise("new")).drop("_known")


def lowest_eligible(files: DataFrame, editions: DataFrame) -> DataFrame:
    """(file, edition_ids) to the lowest id of an eligible edition, null if there is none."""
    pairs = files.select("file", F.explode("edition_ids").alias("e_id"))
    best = pairs.join(editions.where((F.coalesce("visible", F.lit("")) == "") & (F.coalesce("title", F.lit("")) != "")).select("e_id"), "e_id", "left_semi").groupBy("file").agg(F.min("e_id").alias("e_id"))
    return files.select("file").join(best, "file", "left")


def _walk(steps: DataFrame, start: int) -> DataFrame:
    """The places (topic, at) that a walk from ``start`` comes by: one pass over each topic's steps in order, of which only the place to go to is held."""

    def run(batches):
        topic, to = None, None
        for batch in batches:
            keep = []
            for i, (t, at, then) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("topic", "at", "next_id")), strict=True)):
                if i == 0 and topic is None or t != topic[0]:
                    topic, to = (t,), start
                if at == to:
                    keep.append(i)
                    to = then
            yield batch.select(["topic", "at"]).take(pa.array(keep, pa.int32()))

    ship(steps.sparkSession)
    kind = dict(steps.dtypes)["topic"]
    return steps.select("topic", "at", "next_id").repartition("topic").sortWithinPartitions("topic", "at").mapInArrow(run, f"topic {kind}, at long")


def _jumps(steps: DataFrame, first: DataFrame) -> DataFrame:
    """The same by doubling steps, so that no task walks a topic."""
    walked, jump, size = first.select("topic", "at"), steps.select("topic", "at", F.col("next_id").alias("to")), -1
    while True:
        reached = walked.join(jump, ["topic", "at"]).select("topic", F.col("to").alias("at"))
        walked = frozen(walked.unionByName(reached).distinct())
        if (now := walked.count()) == size:
            return walked
        size = now
        jump = frozen(jump.join(jump.select("topic", F.col("at").alias("to"), F.col("to").alias("then")), ["topic", "to"]).select("topic", "at", F.col("then").alias("to")))


def windows(ids: DataFrame, page: int, start: int = 0, most_empty: int = MOST_EMPTY) -> DataFrame:
    """The keyset windows that a walk over the ids takes: topic, window_start, rows, next_id of those with rows.

    A walk asks for [next, next + page), goes on behind the greatest id that it
    got, steps over empty windows, and ends at ``most_empty`` of them in a row.
    Where it goes from each id is found for all ids at once; the ids that it really
    comes by from the start on, by a pass over up to WALKED steps, and by doubling
    steps if there are more."""
    seen = ids.where(F.col("id") >= start).groupBy("topic", F.col("id").cast("long").alias("id")).agg(F.count("*").alias("n")).withColumn("cell", F.expr(f"id div {page}"))
    seen = frozen(seen)
    # one row for each cell of a page: the sorting window over cells is a page smaller than the ids
    cells = seen.groupBy("topic", "cell").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    cells = frozen(cells.withColumn("later", F.lead("low").over(Window.partitionBy("topic").orderBy("cell"))))
    ahead = F.coalesce(F.lead("id").over(Window.partitionBy("topic", "cell").orderBy("id")), F.col("later"))
    places = seen.join(cells.select("topic", "cell", "later"), ["topic", "cell"]).select("topic", (F.col("id") + 1).alias("at"), ahead.alias("met"))
    first = cells.groupBy("topic").agg(F.min("low").alias("met")).select("topic", F.lit(start).cast("long").alias("at"), "met")
    places = places.unionByName(first).distinct().withColumn("empty", F.expr(f"(met - at) div {page}")).where(F.col("empty") < most_empty)
    places = places.select("topic", "at", (F.col("at") + F.col("empty") * page).alias("window_start")).withColumns({"end": F.col("window_start") + page, "cell": F.expr(f"(window_start + {page - 1}) div {page}")})
    # the greatest id before a window's end lies in the cell of the end, or in the one before
    marks = seen.select("topic", "cell", F.col("id").alias("pos"), F.lit(1).alias("kind"), "id", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("window_start"))
    marks = marks.unionByName(places.select("topic", "cell", F.col("end").alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "at", "window_start"))
    before = F.max("id").over(Window.partitionBy("topic", "cell").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = marks.withColumn("last", before).where("kind = 0").join(cells.select("topic", (F.col("cell") + 1).alias("cell"), "high"), ["topic", "cell"], "left")
    steps = frozen(ends.select("topic", "at", "window_start", (F.coalesce("last", "high") + 1).alias("next_id")))
    walked = _walk(steps, start) if steps.count() <= WALKED else _jumps(steps, first)
    taken = steps.join(walked, ["topic", "at"], "left_semi").select("topic", "window_start", "next_id")
    spans = taken.withColumn("cell", F.explode(F.array_distinct(F.array(F.expr(f"window_start div {page}"), F.expr(f"(window_start + {page - 1}) div {page}")))))
    held = seen.join(spans, ["topic", "cell"]).where((F.col("id") >= F.col("window_start")) & (F.col("id") < F.col("window_start") + page))
    return held.groupBy("topic", "window_start", "next_id").agg(F.sum("n").alias("rows")).select("topic", "window_start", "rows", "next_id")


def days_to_replay(synced_until: Column, today: Column, catch_up: int = CATCH_UP_DAYS) -> Column:
    """The days from the older of the cursor and today - catch_up on, today included; it is asked again next time."""
    return F.sequence(F.greatest(synced_until, F.date_sub(today, catch_up)), today)


def replay(changes: DataFrame, day: str, key: str, order: list[str]) -> DataFrame:
    """The state after all days: each key's last change in the order of days and ``order``."""
    others = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(day, *order)).alias("_last"))
    return last.select(key, "_last.*")


def upsert_stream(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Drains a stream of changes, a batch at a time, into ``apply``; replaying a batch must not change its result."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
