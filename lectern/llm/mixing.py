"""Mixing sources to target weights by weighted fair queueing (native).

Every document of a source stands in one shuffled queue. A copy of a document
gets the virtual finish time at which a fair server would have sent it: the
words of its source up to and with it, divided by the source's weight. The
second and third copies queue behind a whole pass over the source. Copies are
range-sorted by finish time and the mix is what fits into the total budget.
Since a source's queue ends after ``max_repeats`` passes, the budget that a
small source can't use goes to the others by weight.

Defined results: null text has size 0; documents of size 0 are never taken;
null sources form one source, the last; equal rows are separate documents; an
empty table gives an empty mix; columns of the input keep their names and
values, those of the mix begin with ``_mix_``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, shuffle_partitions, words

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = "mix-1"
#: Sources' statistics are broadcast up to this count (about 100 bytes each).
BROADCAST_SOURCES = 100_000


def _queue_key(docs: DataFrame, digits: int) -> DataFrame:
    order = F.md5(F.concat_ws("|", F.lit(SEED), F.col("doc_id").cast("string")))
    return docs.withColumns({
        "_mix_size": words(F.col("text")), "_mix_order": order, "_mix_cell": F.substring(order, 1, digits), "_mix_tie": F.crc32("text"),
        "_mix_key": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")),  # null is a source too
    })


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats=MAX_REPEATS) -> DataFrame:
    """(source, _mix_source_size) to rank, weight and target of each source.

    Sources are ranked by code point in ranges, so that any number of them will
    do. Targets are levelled by rounds of sums: what sources that reach their
    cap can't use raises the level of the others, until no more reach it.
    """
    spark = sizes.sparkSession
    order = F.col("source").asc_nulls_last()
    ranged = saved(sizes.repartitionByRange(shuffle_partitions(spark), order).withColumn("_mix_part", F.spark_partition_id()), "mix-sources")
    before = Window.partitionBy().orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = ranged.groupBy("_mix_part").agg(F.count("*").alias("n")).select("_mix_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_mix_first"))
    rank = F.row_number().over(Window.partitionBy("_mix_part").orderBy(order)) - 1
    ranked = ranged.withColumn("_mix_rank", rank).join(F.broadcast(offsets), "_mix_part").withColumn("_mix_sid", (F.col("_mix_rank") + F.col("_mix_first")).cast("long"))
    ranked = saved(ranked.select(
        "source", "_mix_sid", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_mix_sid") % len(weights) + 1).cast("int")).alias("_mix_weight"),
        "_mix_source_size", (F.col("_mix_source_size") * max_repeats).alias("_mix_cap")), "mix-ranked")
    ratio = F.col("_mix_cap") / F.col("_mix_weight")
    total, level, capped = ranked.agg(F.sum("_mix_source_size")).first()[0], 0.0, -1
    while True:
        full = ratio < level
        n, caps, shares = ranked.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("_mix_cap"))), F.lit(0)), F.sum(F.when(~full, F.col("_mix_weight")))).first()
        if n == capped or not shares:
            break
        level, capped = (total - caps) / shares, n
    cap = F.col("_mix_cap").cast("double")
    return ranked.select("source", "_mix_sid", "_mix_weight", "_mix_source_size", F.least(cap, F.lit(float(level)) * F.col("_mix_weight")).alias("_mix_target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, text and any others) with ``_mix_size``,
    ``_mix_source_size``, ``_mix_target`` and ``_mix_copies``, the times a row is taken.

    keep: the columns to carry along, all if not given; texts that aren't kept aren't shuffled."""
    spark, columns = docs.sparkSession, docs.columns if keep is None else keep
    # Cells are hash ranges of a queue: no task ever holds a hot source. Their
    # count follows the rows; the order of the queue doesn't depend on it.
    digits = min(4, max(0, int(math.log(max(docs.count() / 64, 1), 16))))
    queue = _queue_key(docs, digits).select(*columns, *[c for c in ("source",) if c not in columns], "_mix_key", "_mix_cell", "_mix_order", "_mix_size", "_mix_tie")
    if "text" not in columns:
        queue = saved(queue, "mix-queue")  # texts are read once
    cells = saved(
        queue
        .groupBy("source", "_mix_cell").agg(F.sum("_mix_size").alias("_mix_cell_size"), F.count("*").alias("_mix_rows")),
        "mix-cells",
    )
    targets = saved(source_targets(cells.groupBy("source").agg(F.sum("_mix_cell_size").alias("_mix_source_size")), weights, max_repeats), "mix-targets")
    known = targets.agg(F.count("*").alias("n"), F.coalesce(F.sum("_mix_source_size"), F.lit(0)).alias("budget")).first()
    if known["n"] <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    before = Window.partitionBy("source").orderBy("_mix_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("_mix_before", F.coalesce(F.sum("_mix_cell_size").over(before), F.lit(0)))
    offsets = offsets.join(targets.withColumnRenamed("source", "_mix_s"), F.col("source").eqNullSafe(F.col("_mix_s"))).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_mix_key"), "_mix_cell", "_mix_before", "_mix_sid", "_mix_weight", "_mix_source_size", "_mix_target")
    within = Window.partitionBy("_mix_key", "_mix_cell").orderBy("_mix_order", "_mix_size", "_mix_tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = saved(
        queue.select(*columns, "_mix_key", "_mix_cell", "_mix_order", "_mix_size", "_mix_tie")
        .withColumn("_mix_upto", F.sum("_mix_size").over(within))
        .join(offsets, ["_mix_key", "_mix_cell"])
        .withColumn("_mix_upto", F.col("_mix_upto") + F.col("_mix_before"))
        .select(*columns, "_mix_size", "_mix_source_size", "_mix_target", "_mix_sid", "_mix_weight", "_mix_upto"),
        "mix-placed",
    )

    def finish(turn):
        return (turn * F.col("_mix_source_size") + F.col("_mix_upto")) / F.col("_mix_weight")

    copies = placed.where("_mix_size > 0").select(
        "_mix_size", "_mix_sid", "_mix_source_size", "_mix_upto", "_mix_weight", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("turn"))
    key = ["finish", "_mix_sid", "turn"]
    ranged = saved(
        copies.select("_mix_size", "_mix_sid", "turn", finish(F.col("turn")).alias("finish"))
        .repartitionByRange(shuffle_partitions(spark), *key).sortWithinPartitions(*key)
        .withColumn("part", F.spark_partition_id()),
        "mix-ranged",
    )
    # One row per range: which range the budget ends in, and what stands before it.
    upto = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    crossing = ranged.groupBy("part").agg(F.sum("_mix_size").alias("size")).withColumn("upto", F.sum("size").over(upto)).where(F.col("upto") > known["budget"]).orderBy("part").first()
    first_out = None
    if crossing:
        inside = Window.partitionBy("part").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
        over = ranged.where(F.col("part") == crossing["part"]).withColumn("upto", F.sum("_mix_size").over(inside) + (crossing["upto"] - crossing["size"]))
        first_out = over.where(F.col("upto") > known["budget"]).orderBy(*key).select(*key).first()
    taken = F.lit(0)
    for turn in range(max_repeats):
        fits = F.lit(True) if first_out is None else F.struct(finish(F.lit(turn)), F.col("_mix_sid"), F.lit(turn)) < F.struct(F.lit(first_out["finish"]), F.lit(first_out["_mix_sid"]).cast("long"), F.lit(first_out["turn"]))
        taken = taken + F.when(fits & (F.col("_mix_size") > 0), 1).otherwise(0)
    return placed.select(*columns, "_mix_size", "_mix_source_size", "_mix_target", taken.alias("_mix_copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as many times as it is taken, with the columns of ``docs``."""
    columns = docs.columns
    mix = mix_sources(docs, **options)
    return mix.where("_mix_copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))).alias("_mix_copy")).select(*columns)


def op1(docs: DataFrame) -> DataFrame:
    mix = mix_sources(docs, keep=["doc_id"])
    return mix.select(
        "doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"),
        F.round("_mix_target", 6).alias("target"), (F.col("_mix_size") * F.col("_mix_copies")).cast("long").alias("taken"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1|' || CAST(doc_id AS VARCHAR)) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s),
w AS (SELECT *, sid % 3 + 1 AS weight, source_size * 3 AS cap FROM r),
l AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, sid) AS n,
         (sum(source_size) OVER () - sum(cap) OVER (ORDER BY cap / weight, sid ROWS UNBOUNDED PRECEDING) + cap)
         / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
v AS (SELECT arg_min(level, n) AS level FROM l WHERE level <= cap / weight),
t AS (SELECT l.*, least(cap::DOUBLE, (SELECT level FROM v) * weight) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.sid, t.weight, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY (turn * source_size + upto) / weight, sid, turn ROWS UNBOUNDED PRECEDING) AS running
  FROM p, (VALUES (0), (1), (2)) AS x(turn) WHERE size > 0),
k AS (SELECT doc_id, sum(size) AS taken FROM c WHERE running <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, round(p.target, 6) AS target, coalesce(k.taken, 0)::BIGINT AS taken
FROM p LEFT JOIN k ON p.doc_id = k.doc_id
"""
