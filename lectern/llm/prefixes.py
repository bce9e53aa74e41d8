"""The trie of all beginnings of conversations, by collapsing whole sequences.

Equal conversations are one weighted sequence. Each beginning of a sequence is a
node; its identity is the exclusive or of the hashes of (place, turn) of its
turns, so that it comes from sums over places and no text is moved. Sequences
that are no proper beginning of another (an anti-join) are the leaves. All figures
of a node are sums over the weighted beginnings:

- conversations, leaves: plain sums;
- text of the subtree, each node's once for each conversation: what the sequence
  has from this depth on, times its weight;
- text of the subtree, each node's once: the same without weights, for the part of
  the sequence whose nodes have no smaller member than its own. Such a part is
  always a sequence's end, so a sequence adds it either whole or from this depth on.

No task holds a conversation: turns are numbered over ranges of rows, and sums
over places are taken in blocks of turns. Nodes with a large share of all children
are few, and meet their children by broadcast, all others in a shuffled join. The
ids that end at a node are written into strings range by range before one task
reads the strings of a node, in order.

Defined results: null roles and texts are empty; turns with one number are in the
order of role and then of the text's MD5; rows of a conversation that repeat are
turns of their own; rows without an id, or with one that is no whole number, take
no part; an empty table gives no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, ship, shuffle_partitions

#: Turns of a conversation that are summed up together, and ids of a node that are written into one string.
BLOCK, IDS = 1024, 4096
#: Nodes that have at least so small a share of all nodes as children are broadcast: there are no more than its inverse.
HOT_PARENTS = 10_000
#: A conversation begins with the first turns of the one whose id has these last digits zero.
FAMILY = 100


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, role, digest, chars) of all turns, places from 1, and (conv_id, n) of all conversations."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select(
        F.col("conv_id").try_cast("long").alias("conv_id"), "turn", role.alias("role"), F.md5(text.cast("binary")).alias("digest"), F.char_length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row")
    ).where("conv_id is not null")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("row")]
    dealt = turns.repartitionByRange(shuffle_partitions(conversations.sparkSession), "conv_id", *order).withColumn("part", F.spark_partition_id())
    dealt = saved(dealt, "turns")
    parts = saved(dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n")), "parts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("conv_id", "part", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) + F.col("before")
    places = dealt.join(offsets, ["conv_id", "part"]).select("conv_id", place.cast("long").alias("place"), "role", "digest", "chars")
    return places, parts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations and all ids: the head of the family's first conversation, then the own turns after it."""
    places, convs = numbered(conversations)
    places, head = saved(places, "places"), (F.crc32(F.col("conv_id").cast("string")) % 6).alias("head")
    family = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family")
    convs = saved(convs.select("conv_id", "n", head, family), "conversations")
    first = convs.select(F.col("conv_id").alias("family"), F.col("n").alias("family_n"))
    convs_taken = convs.join(first, "family", "left").select("conv_id", "head", "family", F.least("head", F.coalesce("family_n", F.lit(0))).alias("taken"), "n")
    # at most five turns of a conversation go to at most 199 others
    few = places.where((F.col("place") <= 5) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "family")
    heads = few.join(convs, "family").where("place <= head").select("conv_id", "place", "role", "digest", "chars")
    # only the first turns can be missing, so a conversation's rows meet one row for each of its blocks
    blocks = convs_taken.select("conv_id", "head", "taken", F.explode(F.sequence(F.lit(0), F.expr(f"n div {BLOCK}"))).alias("block"))
    own = places.withColumn("block", F.expr(f"place div {BLOCK}")).join(blocks, ["conv_id", "block"]).where("place > head")
    own = own.select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("place"), "role", "digest", "chars")
    return heads.unionByName(own), convs.select("conv_id")


def _joined_ids(batches):
    """Sorted (key..., conv_id) to strings of up to IDS ids each, with the first of them."""
    key, ids, names = None, [], None

    def told(keys_ids):
        cols = [pa.array([r[k] for r in keys_ids], pa.int64()) for k in range(4)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([",".join(map(str, r[4])) for r in keys_ids])], names)

    for batch in batches:
        names, out = ["x", "y", "depth", "first", "ids"], []
        for row in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "depth", "conv_id")), strict=True):
            if key != row[:3] or len(ids) >= IDS:
                if ids:
                    out.append((*key, ids[0], ids))
                key, ids = row[:3], []
            ids.append(row[3])
        if out:
            yield told(out)
    if ids:
        yield told([(*key, ids[0], ids)])


def _hashed(batches):
    """Sorted strings to one SHA-256 a key, fed string by string."""
    key, h = None, None
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "depth", "ids")), strict=True):
            if key != row[:3]:
                if key is not None:
                    out.append((*key, h.hexdigest()))
                key, h = row[:3], hashlib.sha256()
            else:
                h.update(b",")
            h.update(row[3].encode())
        if out:
            yield _hash_rows(out)
    if key is not None:
        yield _hash_rows([(*key, h.hexdigest())])


def _hash_rows(rows):
    return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[3] for r in rows])], ["x", "y", "depth", "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(x, y, depth, ends_sha256) of (x, y, depth, conv_id): all ids of a key in ascending order, joined by commas."""
    n, key = shuffle_partitions(ends.sparkSession), ["x", "y", "depth"]
    parts = ends.repartitionByRange(n, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    parts = parts.mapInArrow(_joined_ids, "x long, y long, depth long, first long, ids string")
    return parts.repartition(n, *key).sortWithinPartitions(*key, "first").mapInArrow(_hashed, "x long, y long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, place, role, digest, chars), places from 1 without gaps; ids: all conversations, with or without turns."""
    ship(turns.sparkSession)
    key = ["x", "y", "depth"]
    one = turns.select("conv_id", F.expr(f"place div {BLOCK}").alias("block"), "place", F.xxhash64("place", "role", "digest").alias("a"), F.xxhash64("digest", "role", "place").alias("b"), "chars")
    one = saved(one, "rebuilt")
    blocks = saved(one.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("chars").alias("chars"), F.count("*").alias("n")), "blocks")
    whole = blocks.groupBy("conv_id").agg(F.bit_xor("a").alias("x"), F.bit_xor("b").alias("y"), F.sum("chars").alias("total"), F.sum("n").alias("depth"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("x", "y", "total", "depth")]
    whole = saved(ids.join(whole, "conv_id", "left").select("conv_id", *zero), "wholes")
    # equal conversations are one sequence, named by its least member
    sequences = saved(whole.groupBy(*key).agg(F.min("conv_id").alias("s"), F.count("*").alias("weight"), F.max("total").alias("total")), "sequences")

    # all beginnings of the sequences
    last = F.expr(f"depth div {BLOCK}")
    known = sequences.select(F.col("s").alias("conv_id"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), "weight", "total")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    sums = blocks.select("conv_id", "block", *[F.coalesce(f(c).over(earlier), none).alias(f"{c}0") for c, f in (("a", F.bit_xor), ("b", F.bit_xor), ("chars", F.sum))])
    within = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = one.join(known.join(sums, ["conv_id", "block"]), ["conv_id", "block"])
    path = path.withColumns({"x": F.bit_xor("a").over(within).bitwiseXOR(F.col("a0")), "y": F.bit_xor("b").over(within).bitwiseXOR(F.col("b0")), "so_far": F.sum("chars").over(within) + F.col("chars0")})
    path = path.select(
        F.col("conv_id").alias("s"), "block", F.col("place").alias("depth"), "x", "y", F.col("x").bitwiseXOR(F.col("a")).alias("px"), F.col("y").bitwiseXOR(F.col("b")).alias("py"), "chars", "weight",
        (F.col("total") - F.col("so_far") + F.col("chars")).alias("rest"))
    root = sequences.select("s", none.alias("block"), none.alias("depth"), none.alias("x"), none.alias("y"), F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"), none.alias("chars"), "weight", F.col("total").alias("rest"))
    path = saved(path.unionByName(root), "paths")

    nodes = path.groupBy(*key).agg(F.min("s").alias("conv_id"), F.sum("weight").alias("n_convs"), F.min("chars").alias("chars"), F.min("px").alias("px"), F.min("py").alias("py"), F.sum(F.col("weight") * F.col("rest")).alias("told"))
    nodes = saved(nodes, "nodes")
    inner = saved(nodes.where("depth > 0").groupBy(F.col("px").alias("x"), F.col("py").alias("y"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children")), "inner")
    leaves = sequences.join(inner, key, "left_anti").select("s", F.lit(1).cast("long").alias("leaf"))
    # the end of a sequence of which it is itself the least member
    own = nodes.groupBy(F.col("conv_id").alias("s")).agg(F.min("depth").alias("since"), F.sum("chars").alias("own"))
    info = sequences.select("s", "depth").join(leaves, "s", "left").join(own, "s", "left")
    info = info.select("s", F.coalesce("leaf", none).alias("leaf"), F.coalesce("own", none).alias("own"), "since", F.explode(F.sequence(none, last)).alias("block"))
    mine = F.when(F.col("depth") >= F.col("since"), F.col("rest")).otherwise(F.col("own"))
    under = path.select("s", "block", "depth", "x", "y", "rest").join(info, ["s", "block"]).groupBy(*key).agg(F.sum("leaf").alias("n_leaves"), F.sum(mine).alias("once"))

    # parents by their children: those with very many are few
    total = nodes.count()
    hot = F.col("n_children") * HOT_PARENTS >= total
    parents = nodes.select(*key, F.col("conv_id").alias("parent_conv_id")).join(inner, key).withColumn("hot", hot)
    parents = saved(parents.select(F.col("x").alias("px"), F.col("y").alias("py"), (F.col("depth") + 1).alias("depth"), "parent_conv_id", "hot"), "parents")
    up = ["px", "py", "depth"]
    few, rest = F.broadcast(parents.where("hot").drop("hot")), parents.where("not hot").drop("hot")
    child = nodes.select(*key, *up[:2])
    named = child.join(few, up).unionByName(child.join(few, up, "left_anti").join(rest, up)).select(*key, "parent_conv_id")

    ends = end_hashes(whole.select(*key, "conv_id"))
    out = nodes.join(under, key).join(inner, key, "left").join(named, key, "left").join(ends, key, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", none).alias("n_children"), "n_leaves", (F.col("told") - F.col("once")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op11(conversations: DataFrame) -> DataFrame:
    return prefix_trie(*rebuilt(conversations))


#: CRC-32 of a decimal, digit by digit: the generator polynomial, reflected, is a fixed value.
ORACLE_SQL = r"""
WITH RECURSIVE
bits(b, i, v) AS (SELECT b::BIGINT, 0, b::BIGINT FROM range(256) t(b) UNION ALL SELECT b, i + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE i < 8),
byte AS (SELECT b, v FROM bits WHERE i = 8),
ids AS (SELECT DISTINCT conv_id::BIGINT AS c, conv_id::BIGINT::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL),
crc(c, s, i, v) AS (
  SELECT c, s, 0, 4294967295::BIGINT FROM ids
  UNION ALL SELECT c, s, i + 1, xor(crc.v // 256, byte.v) FROM crc JOIN byte ON byte.b = xor(crc.v % 256, ascii(substr(s, i + 1, 1))) WHERE i < length(s)),
h AS (SELECT c, xor(v, 4294967295) % 6 AS h FROM crc WHERE i = length(s)),
t AS (
  SELECT conv_id::BIGINT AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT h.c, h, c - c % 100 AS b, least(h, coalesce((SELECT max(p) FROM t WHERE t.c = h.c - h.c % 100), 0)) AS taken FROM h),
r AS (
  SELECT n.c, p, role, text FROM n JOIN t ON t.c = n.b AND t.p <= n.h
  UNION ALL SELECT n.c, p - h + taken, role, text FROM n JOIN t ON t.c = n.c AND t.p > n.h),
k AS (SELECT c, p AS d, length(text) AS chars, string_agg(md5(role) || md5(text), ',') OVER (PARTITION BY c ORDER BY p) AS k FROM r UNION ALL SELECT c, 0, 0, '' FROM ids),
u AS (SELECT c, d, chars, k, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM k),
v AS (SELECT k, d, min(c) AS c, count(*) AS n, any_value(chars) AS chars, any_value(up) AS up, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends FROM u GROUP BY k, d),
kids AS (SELECT up AS k, d - 1 AS d, count(*) AS n FROM v WHERE d > 0 GROUP BY ALL),
below AS (SELECT a.k, a.d, count(*) FILTER (kids.n IS NULL) AS leaves, sum((v.n - 1) * v.chars) AS saved FROM v JOIN u a ON a.c = v.c AND a.d <= v.d LEFT JOIN kids ON kids.k = v.k AND kids.d = v.d GROUP BY a.k, a.d)
SELECT v.c AS conv_id, v.d::BIGINT AS depth, p.c AS parent_conv_id, v.n AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, below.leaves AS n_leaves, below.saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN below ON below.k = v.k AND below.d = v.d LEFT JOIN kids ON kids.k = v.k AND kids.d = v.d LEFT JOIN v p ON p.k = v.up AND p.d = v.d - 1
"""
