"""Sharding by minimax contiguous partition (native).

Equal texts form an atomic group. Groups stand in the order of their digest;
the smallest capacity with which greedy cutting needs at most ``n_shards``
shards is searched, and the cuts of that capacity are taken. A greedy step for
many capacities at once is one aggregate over the table of group ends, which is
stored in order, so that each step reads only the row groups around the cuts.

Defined results: null text counts as empty text; with fewer groups than shards
the last shards stay empty; equal rows get slots of their own; an empty table
gives no rows; the columns asked for in ``keep`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import power_of_two, saved, shuffle_partitions

SHARDS = 16
#: Capacities tried at once in a round of the search; rows of the summary that brackets it.
TRIED, BLOCKS = 128, 65_536


def bracket(summary: list[tuple[int, int, int]], width: int, total: int, largest: int, shards: int) -> tuple[int, int]:
    """(infeasible, feasible) capacities from the least and greatest end in each of the ``width`` wide blocks."""
    blocks, ends_before = {k: (least, most) for k, least, most in summary}, {}
    last = 0
    for k in range(total // width + 1):
        ends_before[k] = last
        last = blocks[k][1] if k in blocks else last

    def reach(capacity: int, surely: bool) -> bool:
        at = 0
        for _ in range(shards):
            x = at + capacity
            if x >= total:
                return True
            least, most = blocks.get(x // width, (x + 1, x + 1))
            at = ends_before[x // width] if x < least else most if x >= most else least if surely else x
        return at >= total

    def first(low: int, high: int, surely: bool) -> int:
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if reach(mid, surely) else (mid, high)
        return high

    # One shard must hold the largest group and the mean; mean + largest always suffices.
    low = max(-(-total // shards), largest) - 1
    high = first(low, low + 1 + largest, True)
    return first(low, high, False) - 1, high


def smallest_capacity(ends: DataFrame, total: int, largest: int, shards: int, blocks: int = BLOCKS) -> list[int]:
    """Ends of the shards under the smallest feasible capacity. ends: ``end`` of each group, in order.

    A summary of at most ``blocks`` rows brackets the capacity; the table of
    ends then decides within the bracket, ``TRIED`` capacities at once.
    """
    width = -(-total // blocks)
    summary = ends.groupBy(F.floor(F.col("end") / F.lit(width)).alias("k")).agg(F.min("end"), F.max("end"))

    def cuts(capacities: list[int]) -> list[list[int]]:
        at = [[0] for _ in capacities]
        for _ in range(shards):
            open_ = [i for i, x in enumerate(at) if x[-1] < total]
            if not open_:
                break
            upto = [at[i][-1] + capacities[i] for i in open_]  # ascending, as the capacities are
            first_fit = F.expr(f"size(filter(array({', '.join(f'{x}L' for x in upto)}), x -> x < `end`))")
            near = ends.where((F.col("end") > min(at[i][-1] for i in open_)) & (F.col("end") <= upto[-1]))
            got = dict(near.groupBy(first_fit.alias("k")).agg(F.max("end")).collect())  # a row per capacity at most
            end = 0
            for k, i in enumerate(open_):
                end = max(end, got.get(k, 0))
                at[i].append(end)
        return at

    low, high = bracket([tuple(r) for r in summary.collect()], width, total, largest, shards)
    best = None
    while best is None or high - low > 1:
        step = max(1, -(-(high - low) // TRIED))
        tried = sorted({*range(low + step, high, step), *([high] if best is None else [])})
        for capacity, at in zip(tried, cuts(tried), strict=True):
            if at[-1] >= total:
                high, best = capacity, at
                break
            low = capacity
    return best[1:]


def shard_bytes(docs: DataFrame, n_shards: int = SHARDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in ``keep`` and size, text_crc32, shard and slot, prefixed with ``_shard_``."""
    spark = docs.sparkSession
    n = docs.count()
    buckets, subs = power_of_two(n / 128, 65536), power_of_two(n / 1024, 65536)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = saved(docs.select(
        "doc_id", *keep, (F.octet_length(text) + 1).cast("long").alias("_shard_size"), F.crc32(text).alias("_shard_crc"), F.unhex(F.md5(text)).alias("_shard_g"),
        # a large group of equal texts is counted in so many parts
        F.pmod(F.xxhash64("doc_id"), F.lit(subs)).cast("int").alias("_shard_sub"),
    ), "shard-rows")
    bucket = F.shiftright(F.conv(F.hex(F.substring("_shard_g", 1, 2)), 16, 10).cast("int"), 16 - (buckets.bit_length() - 1))
    cells = rows.groupBy("_shard_g", "_shard_sub").agg(F.count("*").alias("n"), F.sum("_shard_size").alias("bytes")).withColumn("bucket", bucket)
    w = Window.partitionBy("bucket").orderBy("_shard_g", "_shard_sub")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    other = lambda f: ~F.coalesce(f("_shard_g").over(w) == F.col("_shard_g"), F.lit(False))
    inside = saved(cells.withColumns({
        "row0": F.sum("n").over(upto) - F.col("n"), "end": F.sum("bytes").over(upto), "first": other(F.lag), "last": other(F.lead),
    }).withColumn("start", F.max(F.when(F.col("first"), F.col("end") - F.col("bytes"))).over(upto)), "shard-cells")
    totals = inside.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))  # at most 65,536 rows
    before = Window.partitionBy().orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("bucket", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("n", "bytes")])
    cells = saved(inside.join(F.broadcast(offsets), "bucket").select(
        "_shard_g", "_shard_sub", "last", (F.col("row0") + F.col("n0")).alias("row0"), (F.col("start") + F.col("bytes0")).alias("start"), (F.col("end") + F.col("bytes0")).alias("end")), "shard-placed")
    known = cells.where("last").agg(F.max("end").alias("total"), F.max(F.col("end") - F.col("start")).alias("largest")).first()
    cuts = []
    if n:
        ends = saved(cells.where("last").select("end").repartitionByRange(max(1, min(shuffle_partitions(spark), n // 10_000)), "end").sortWithinPartitions("end"), "shard-ends")
        cuts = smallest_capacity(ends, known["total"], known["largest"], n_shards)
    shard = sum((F.when(F.col("start") >= c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0))
    cells = cells.withColumn("_shard_shard", shard)
    first = {r[0]: r[1] for r in cells.groupBy("_shard_shard").agg(F.min("row0")).collect()}  # one row per shard
    row0 = F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.col("_shard_shard")) if first else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("_shard_g", "_shard_sub").orderBy("doc_id", *keep)) - 1
    return rows.withColumn("rank", rank).join(cells, ["_shard_g", "_shard_sub"]).select(
        "doc_id", *keep, "_shard_size", "_shard_crc", F.col("_shard_shard"), (F.col("row0") - row0 + F.col("rank")).cast("long").alias("_shard_slot"))


def op2(docs: DataFrame) -> DataFrame:
    return shard_bytes(docs).select(
        "doc_id", F.col("_shard_size").alias("size"), F.col("_shard_crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("_shard_shard").cast("int").alias("shard"), F.col("_shard_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
