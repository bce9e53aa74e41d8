"""Near-duplicate documents by min-max hashing.

A document's set is its distinct word shingles. Under each permutation both the
least and the greatest value are kept, so half the hash evaluations fill a
signature; bands of four values bucket the documents. Documents with equal sets
are one class from the start, so a group of copies costs one row per band.

Links are confirmed on whole sets. No large bucket emits all its pairs: its members
are tested against hubs, one round after another, best member first; a bucket with
one component left drops out whole. Buckets of up to eight sets list their pairs,
and buckets with the same members count once. Before that, sets of which too many
shingles occur in no other candidate are left out, as is a pair of sets too far
apart in size; both bound the overlap from above and lose no link. Buckets that
the hubs leave in several components meet once more, in blocks of bounded size,
where tasks count the overlaps of all members and emit links that join components
only, fewer than there are members.

Defined results: null and empty texts have an empty set and link with nothing;
a text with fewer words than a shingle is one shingle; the texts of a repeated id
are linked with each other; rows without an id take no part in links, but go with
the rows whose set is the same; ties between hubs go to the first set; an empty
table gives no rows; other columns are ignored. A document's own set is held whole
by one task, however long its text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import saved, ship

#: Signature of 96 values from 48 permutations in 24 bands of 4: a pair at similarity 0.8 is missed with 3 in a million.
PERMUTATIONS, BAND = 48, 4
SHINGLE, PERCENT = 4, 80
#: Members of a bucket that list their pairs; hubs of larger ones that are tested before the rest meets in blocks of so many members and, about, so many shingles.
LISTED, HUB_ROUNDS, BLOCK, BLOCK_SHINGLES = 8, 2, 512, 4_000_000
#: Ids of candidates are broadcast up to this count (16 MB).
BROADCAST_IDS = 1_000_000

_rng = np.random.Generator(np.random.PCG64(77))
_XOR = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.int64).astype(np.uint64)
_ODD = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column, n: int):
    """(rows, hashes, offsets) of the distinct shingles of runs of texts."""
    for i, j, data, at in K.chunks(column):
        t = K.Texts(data, at, lower=True)
        start, end, words = t.words()
        h, owner, _ = K.windows(t.hashes(start, end), words, n, short=True)
        yield i, j, *K.distinct(h, owner, j - i)


def band_value(b: int, k: int) -> int:
    """The place in the signature of value k of band b: each is used once, and those of a band come from different permutations."""
    bands = 2 * PERMUTATIONS // BAND
    # two least values, then two greatest ones of the permutations that the next band takes the least of
    return ((b + k // 2) % bands + k % 2 * bands) * 2 + k // 2


def minmax_bands(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Band values, a row per set; sets must not be empty."""
    signature = np.empty((2 * PERMUTATIONS, len(at) - 1), np.uint64)
    for k in range(PERMUTATIONS):
        y = (h ^ _XOR[k]) * _ODD[k]
        signature[2 * k], signature[2 * k + 1] = np.minimum.reduceat(y, at[:-1]), np.maximum.reduceat(y, at[:-1])
    bands = 2 * PERMUTATIONS // BAND
    out = np.empty((len(at) - 1, bands), np.uint64)
    for b in range(bands):
        x = np.full(len(at) - 1, b, np.uint64)
        for k in range(BAND):
            x = K.mix64(x * _ODD[0] + signature[band_value(b, k)])
        out[:, b] = x
    return out


def set_sums(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two 64-bit sums that stand for each set; 0 for an empty one."""
    out, full = np.zeros((2, len(at) - 1), np.uint64), np.flatnonzero(np.diff(at))
    if len(full):
        for k in range(2):
            out[k, full] = np.add.reduceat(K.mix64(h ^ _XOR[k]), at[:-1][full])
    return out.view(np.int64)


def _signatures(n: int):
    def run(batches):
        for batch in batches:
            for i, j, h, at in shingle_sets(batch.column("text"), n):
                size = np.diff(at)
                full = np.flatnonzero(size)
                bands = minmax_bands(h, np.append(at[:-1][full], len(h))) if len(full) else np.zeros((0, 2 * PERMUTATIONS // BAND), np.uint64)
                each = np.zeros(j - i + 1, np.int64)
                each[full + 1] = bands.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(size), *map(pa.array, set_sums(h, at)), K.lists(bands.ravel(), np.cumsum(each))], ["doc_id", "n", "h1", "h2", "bands"])

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            for i, j, h, at in shingle_sets(batch.column("text"), n):
                wanted = np.stack([batch.column(c).slice(i, j - i).to_numpy() for c in ("h1", "h2")])
                # an id may have other texts than the one that stands for the set
                yield pa.RecordBatch.from_arrays([batch.column("cid").slice(i, j - i), K.lists(h, at)], ["cid", "shingles"]).filter(pa.array((set_sums(h, at) == wanted).all(axis=0)))

    return run


def _few(df: DataFrame, most: int) -> DataFrame:
    """The table, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= most else df


def sets_of(slim: DataFrame, scan: DataFrame, sets: DataFrame, shingle: int) -> DataFrame:
    """(cid, shingles): the whole sets of ``sets`` (cid, h1, h2, first_doc), from the texts ``slim``; scan: (doc_id) of all rows."""
    texts = slim.join(_few(sets.select("cid", "h1", "h2", "first_doc"), BROADCAST_IDS), slim["doc_id"] == F.col("first_doc")).select("cid", "h1", "h2", "text")
    whole = texts.mapInArrow(_sets(shingle), "cid long, shingles array<long>")
    if not scan.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        whole = whole.dropDuplicates(["cid"])
    return saved(whole, "shingles")


def shared_keys(each: DataFrame) -> DataFrame:
    """key, c, same: the keys of (cid, key) that several sets have, with how many; of those with the same sets one, and how many there are."""
    h = F.xxhash64("cid")
    shared = each.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("y")).where("c > 1")
    return saved(shared.groupBy("c", "x", "y").agg(F.min("key").alias("key"), F.count("*").alias("same")).select("key", "c", "same"), "shared")


def _linked(percent: int):
    """Links between members of different components in each (key, g1, g2), at most one fewer than components."""

    def links(rows: list[tuple]) -> list[tuple]:
        across = rows[0][1] != rows[0][2]
        left = [r for r in rows if not across or r[3] == r[1]]
        right = [r for r in rows if r[3] == r[2]] if across else left
        if not left or not right:
            return []
        sizes = np.array([len(r[6]) for r in left])
        values = np.concatenate([r[6] for r in left])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], np.repeat(np.arange(len(left)), sizes)[order]
        joined: dict = {}

        def root(x):
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        out = []
        for r in right:
            lo, hi = np.searchsorted(values, r[6]), np.searchsorted(values, r[6], "right")
            width = hi - lo
            at = np.arange(width.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(width)[:-1]]), width)
            common = np.bincount(owner[at], minlength=len(left))
            for k in np.flatnonzero(100 * common >= percent * (sizes + len(r[6]) - common)):
                x, y = root(left[k][5]), root(r[5])
                if x != y:
                    joined[max(x, y)] = min(x, y)
                    out.append((min(left[k][4], r[4]), max(left[k][4], r[4])))
        return out

    def run(batches):
        group: list[tuple] = []
        out: list[tuple] = []
        kind = None
        for batch in batches:
            kind = batch.schema.field("cid").type
            shingles = batch.column("shingles")
            flat, at = shingles.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(shingles.offsets) - shingles.offsets[0].as_py()
            columns = [batch.column(c).to_pylist() for c in ("key", "g1", "g2", "own", "cid", "root")]
            for i, row in enumerate(zip(*columns, strict=True)):
                if group and group[0][:3] != row[:3]:
                    out += links(group)
                    group = []
                group.append((*row, flat[at[i] : at[i + 1]]))
        out += links(group) if group else []
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k in (0, 1)], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough."""
    a, b = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(cid, root): the least id that links reach, by large-star and small-star steps until nothing moves."""
    def state(stars: DataFrame) -> tuple:
        h = F.xxhash64("u", "v")
        return tuple(stars.agg(F.count("*"), F.bit_xor(h), F.sum(h.bitwiseAND(0xFFFFFFFF))).first())

    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = state(edges)
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        edges = saved(small, "stars")
        after = state(edges)
        if after == before:
            return edges.select(F.col("u").alias("cid"), F.col("v").alias("root"))
        before = after


def possible(a: str, b: str, percent: int) -> Column:
    """Whether sets a and b, structs of n and common, can be similar by their sizes and by what they share with any set."""
    least = F.least(F.col(f"{a}.common"), F.col(f"{b}.common"))
    return (F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent) & (least * 100 >= (F.col(f"{a}.n") + F.col(f"{b}.n") - least) * percent)


def linked(rows: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all similar sets which share a key: rows are key, cid, n, common, c (members of the key), same (keys like it)."""
    listed = rows.where(f"c <= {LISTED}").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("cid", "n", "common"))).alias("m"))
    pairs = listed.select("m", F.posexplode("m").alias("i", "a")).select("a", F.explode(F.expr(f"slice(m, i + 2, {LISTED})")).alias("b")).where(possible("a", "b", percent)).select(F.col("a.cid").alias("a"), F.col("b.cid").alias("b"))
    large = saved(rows.where(f"c > {LISTED}").join(rows.groupBy("cid").agg(F.sum(F.col("c") * F.col("same")).alias("met")), "cid").select("key", "cid", "n", "common", "met", F.col("cid").alias("root")), "large")
    links = None
    for turn in range(1, HUB_ROUNDS + 1):
        # the member that meets the most others is the hub; the next one comes from another component
        late = F.lit(False) if turn == 1 else F.col("root") == F.col("last_root")
        free = large if turn == 1 else large.join(last, "key")
        best = free.groupBy("key").agg(F.min(F.struct(late.alias("late"), (-F.col("met")).alias("far"), F.struct("cid", "n", "common").alias("hub"), "root")).alias("b"))
        hubs = saved(best.select("key", "b.hub", F.col("b.root").alias("hub_root")), "hubs")
        met = large.select("key", F.struct("cid", "n", "common").alias("m"), "root").join(hubs, "key").where((F.col("root") != F.col("hub_root")) & possible("m", "hub", percent))
        met = met.select(F.least("m.cid", "hub.cid").alias("a"), F.greatest("m.cid", "hub.cid").alias("b"))
        pairs = saved((pairs.unionByName(met) if turn == 1 else met).distinct(), "pairs")
        found = saved(confirmed(pairs, shingles, percent), "links")
        links = found if links is None else links.unionByName(found)
        roots = components(shingles.sparkSession, links)
        large = saved(large.drop("root").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "large")
        apart = large.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        apart = saved(apart.select("key", F.ceil(F.greatest(F.col("c") / BLOCK, F.col("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "apart")
        last = large.join(hubs.select("key", F.col("hub.cid").alias("cid")), ["key", "cid"]).select("key", F.col("root").alias("last_root"))
        large = large.join(apart.select("key"), "key", "left_semi")
    if apart.isEmpty():
        return links
    blocks = large.join(apart, "key").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    blocks = blocks.select("key", "own", "cid", "root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    blocks = blocks.select("key", F.least("own", "other").alias("g1"), F.greatest("own", "other").alias("g2"), "own", "cid", "root").join(shingles, "cid")
    met = blocks.repartition("key", "g1", "g2").sortWithinPartitions("key", "g1", "g2").mapInArrow(_linked(percent), "a long, b long")
    return links.unionByName(saved(met.distinct(), "links"))


def named_sets(scan: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of the rows ``scan`` (doc_id, n, h1, h2), given links between ``sets`` (cid, n, h1, h2, first_doc).

    A set is named by the least document that has it, a component by the least of its sets' documents."""
    name = ["n", "h1", "h2"]
    named = scan.where("n > 0").groupBy(*name).agg(F.min("doc_id").alias("first_doc"))
    roots = components(scan.sparkSession, links)
    roots = saved(roots.unionByName(roots.select(F.col("root").alias("cid"), "root").distinct()).join(sets, "cid"), "roots")
    least = roots.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = named.join(roots.join(least, "root").select(*name, "component_id"), name, "left")
    named = saved(named.select(*name, F.coalesce("component_id", "first_doc").alias("component_id")), "named")
    rows = scan.select("doc_id", *name).join(named, name, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return joined_by_ids(saved(rows, "rows"))


def joined_by_ids(rows: DataFrame) -> DataFrame:
    """Components that a repeated id is in are one."""
    several = rows.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("a <> b")
    if several.isEmpty():
        return rows
    both = rows.where("n_shingles > 0").join(several.select("doc_id", "a"), "doc_id").select("a", F.col("component_id").alias("b")).where("a <> b").distinct()
    roots = components(rows.sparkSession, both).select(F.col("cid").alias("component_id"), F.col("root").alias("least"))
    return rows.join(roots, "component_id", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("least", "component_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select("doc_id", "text")
    id_type = dict(slim.dtypes)["doc_id"]
    scan = saved(slim.mapInArrow(_signatures(shingle), f"doc_id {id_type}, n long, h1 long, h2 long, bands array<long>"), "signatures")
    # equal sets are one; they are saved once, so that their numbers stay
    sets = scan.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.min_by("bands", "doc_id").alias("bands"))
    sets = saved(sets.select(F.monotonically_increasing_id().alias("cid"), "n", "h1", "h2", "first_doc", "bands"), "sets")
    each = sets.select("cid", F.explode("bands").alias("key"))
    members = saved(each.join(shared_keys(each), "key"), "buckets")

    # whole sets of the candidates, and how many shingles no other candidate has
    ids = members.select("cid").distinct()
    shingles = sets_of(slim, scan, saved(sets.join(ids, "cid", "left_semi").select("cid", "h1", "h2", "first_doc"), "candidates"), shingle)
    alone = shingles.select("cid", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("cid").alias("cid")).where("c = 1").groupBy("cid").agg(F.count("*").alias("alone"))
    open_ = sets.select("cid", "n").join(alone, "cid", "left").select("cid", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common")).where(F.col("common") * 100 >= F.col("n") * percent)
    rows = saved(members.join(_few(saved(open_, "open-sets"), BROADCAST_IDS), "cid"), "members")
    return named_sets(scan, sets, linked(rows, shingles, percent))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with all their columns; of rows with one id, that with the least text and then columns."""
    columns = docs.columns
    found = near_duplicates(docs, shingle, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # rows without an id or with an id of their own stay; only rows that repeat an id are copies
    heads = saved(found.select(F.col("doc_id").alias("_dup_id")).where("_dup_id is not null").distinct(), "heads")
    kept = docs.join(_few(heads, BROADCAST_IDS), docs["doc_id"] == F.col("_dup_id"), "left_semi")
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if repeated:
        first = Window.partitionBy("doc_id").orderBy("text", F.to_json(F.struct(*[docs[c] for c in columns])))
        kept = kept.withColumn("_dup_rank", F.row_number().over(first)).where("_dup_rank = 1")
    return kept.select(*columns).unionByName(docs.where("doc_id is null"))


def op5(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id
"""
