"""A self-join of word n-gram sets on Jaccard similarity, by prefixes of token combinations.

Tokens are a text's distinct word shingles. In one order for all sets - those that
a single set has, rare ones, frequent ones, very frequent ones, by hash within each
class - similar sets share a token early on. A set's prefix is extended until any
partner must share one of its signatures: each rare token is one, of frequent
tokens each pair, of very frequent ones each triple. Combinations are formed within
groups of a class, so that their number stays in proportion to the prefix: of c
tokens of a group, c - k + 1 must be missing before no k-combination is left, and a
prefix ends where these sum up to one more than a partner may lack. The number of
groups grows with the set; sets at the border of two sizes use both. Tokens of one
set need no signature.

Before that, sets that can't have a partner go: those of which more shingles occur
in no other set than a partner may lack. This is counted over all documents, on
shingles with hashes in a fixed part of all values, which is enough for it; then
again on all shingles of the sets that are left.

Signatures shared by up to eight sets list their pairs. Of larger ones, each member
meets hubs, and what stays apart meets in blocks inside tasks; signatures with the
same members count once. All pairs are verified on whole sets.

Defined results: null and empty texts have an empty set and link with nothing; a
text with fewer words than a shingle is one shingle; equal sets are linked; the
texts of a repeated id are linked with each other; rows without an id take no part
in links, but have the component of a set equal to theirs, if any; an empty table
gives no rows; other columns are ignored. One task holds a set at a time whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import saved, ship
from .neardup import BROADCAST_IDS, _few, linked, named_sets, set_sums, sets_of, shared_keys, shingle_sets

SHINGLE, PERCENT = 3, 90
#: Tokens of more sets than RARE are indexed in pairs, of more than OFTEN in triples.
RARE, OFTEN = 8, 64
#: Frequent tokens are broadcast up to this count (16 MB).
BROADCAST_TOKENS = 1_000_000

_SALT = [np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A43, 0xD1342543DE82EF95)]


def lacking(n: int, percent: int) -> int:
    """How many of n tokens a partner may lack."""
    return n - -(-n * percent // 100)


def groups(level: int) -> int:
    """Groups of frequent tokens of sets with 2^level tokens and more."""
    return max(1, 2**level // 32)


def levels(n: int, percent: int) -> list[int]:
    """Size classes that a set of n tokens is indexed under: its own and that of its largest partner."""
    return sorted({n.bit_length() - 1, (n * 100 // percent).bit_length() - 1})


def small_sets(percent: int) -> int:
    """The greatest size of a set that may have unequal partners but too few tokens for combinations; 0 if there is none."""
    return max((n for n in range(1, 4096) if 100 * n >= percent * (n + 1) and any(n - lacking(n, percent) < 1 + 3 * groups(x) for x in levels(n, percent))), default=0)


def signatures(tokens: np.ndarray, kind: np.ndarray, percent: int, small: int) -> np.ndarray:
    """The signatures of a set. kind: 0 of a token that no other set has, 1 of a rare one, 2 or 3 of more frequent ones."""
    n = len(tokens)
    order = np.lexsort((tokens, kind))
    tokens, kind = tokens[order], kind[order]
    out = []
    for level in levels(n, percent):
        g = groups(level)
        group = np.where(kind > 1, kind * g + (K.mix64(tokens ^ _SALT[0]) % np.uint64(g)).astype(np.int64), -1)
        by = np.argsort(group, kind="stable")
        edge = np.flatnonzero(np.append(True, group[by][1:] != group[by][:-1]))
        nth = np.empty(n, np.int64)
        nth[by] = np.arange(n) - np.repeat(edge, np.diff(np.append(edge, n))) + 1
        end = int(np.searchsorted(np.cumsum((kind <= 1) | (nth >= kind)), lacking(n, percent) + 1)) + 1
        out.append(tokens[:end][kind[:end] == 1])
        for k in (2, 3):
            at = np.flatnonzero(kind[:end] == k)
            of = group[at]
            sets = [c for x in np.unique(of) for c in combinations(at[of == x], k)]
            if sets:
                parts = tokens[np.array(sets)]
                h = np.full(len(parts), _SALT[k - 1])
                for c in range(k):
                    h = K.mix64(h ^ parts[:, c]) * _SALT[1]
                out.append(h)
    if n <= small * 100 // percent:
        out.append(K.mix64(tokens ^ _SALT[2]))
    return np.unique(np.concatenate(out))


def part_rate(percent: int) -> int:
    """One in so many shingles tells which sets have too many of their own: 2.5 times what a partner may lack, or all."""
    return max(1, int(1 / (2.5 * (1 - percent / 100)))) if percent < 100 else 64


def _scan(n: int, rate: int):
    def run(batches):
        for batch in batches:
            for i, j, h, at in shingle_sets(batch.column("text"), n):
                size = np.diff(at)
                h1, h2 = set_sums(h, at)
                part = h % np.uint64(rate) == 0
                upto = np.append(0, np.cumsum(part))[at]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(size), pa.array(h1), pa.array(h2), K.lists(h[part], upto)], ["doc_id", "n", "h1", "h2", "part"])

    return run


def _signed(percent: int, small: int):
    def run(batches):
        for batch in batches:
            rows = []
            told = [batch.column(c).to_pylist() for c in ("tokens", "kinds")]
            shingles = batch.column("shingles")
            flat, at = shingles.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(shingles.offsets) - shingles.offsets[0].as_py()
            for r, (known, kinds) in enumerate(zip(*told, strict=True)):
                tokens = flat[at[r] : at[r + 1]]
                kind = np.ones(len(tokens), np.int64)
                if known:
                    kind[np.searchsorted(tokens, np.array(known, np.int64).view(np.uint64))] = kinds
                rows.append(signatures(tokens, kind, percent, small))
            ends = np.cumsum([0, *map(len, rows)])
            yield pa.RecordBatch.from_arrays([batch.column("cid"), K.lists(np.concatenate(rows) if rows else np.zeros(0, np.uint64), ends)], ["cid", "keys"])

    return run


def candidates(slim: DataFrame, scan: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(cid, n, h1, h2, first_doc) of the distinct sets that may have unequal partners, and their (cid, shingles)."""
    may_lack = F.col("n") - F.expr(f"(n * {percent} + 99) div 100")
    sets = scan.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("first_doc")).where(100 * F.col("n") >= percent * (F.col("n") + 1))
    of = scan.where("n > 0 and doc_id is not null").select("h1", "h2", F.explode("part").alias("t")).groupBy("t").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("h1", "h2") for f in (F.min, F.max)])
    lone = of.where("min_h1 = max_h1 and min_h2 = max_h2").groupBy(F.col("min_h1").alias("h1"), F.col("min_h2").alias("h2")).agg(F.count("*").alias("lone"))
    sets = sets.join(lone, ["h1", "h2"], "left").where(F.coalesce("lone", F.lit(0)) <= may_lack)
    # saved once, so that the numbers stay
    sets = saved(sets.select(F.monotonically_increasing_id().alias("cid"), "n", "h1", "h2", "first_doc"), "sets")
    return sets, sets_of(slim, scan, sets, shingle)


def similar(sets: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all similar sets (cid, n) with ``shingles`` (cid, shingles) of theirs."""
    counts = saved(shingles.select("cid", F.explode("shingles").alias("t")).groupBy("t").agg(F.count("*").alias("c"), F.min("cid").alias("cid")), "counts")
    lone = saved(counts.where("c = 1").select("cid", "t"), "lone")
    sets = sets.join(lone.groupBy("cid").agg(F.count("*").alias("lone")), "cid", "left").select("cid", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("common"))
    sets = saved(sets.where(F.col("common") * 100 >= F.col("n") * percent), "open-sets")
    often = saved(counts.where(f"c > {RARE}").select("t", F.when(F.col("c") > OFTEN, 3).otherwise(2).alias("kind")), "frequent")
    hits = shingles.select("cid", F.explode("shingles").alias("t")).join(_few(often, BROADCAST_TOKENS), "t").select("cid", "t", "kind")
    told = hits.unionByName(lone.withColumn("kind", F.lit(0))).groupBy("cid").agg(F.collect_list(F.struct("t", "kind")).alias("told"))
    full = shingles.join(_few(sets.select("cid"), BROADCAST_IDS), "cid", "left_semi").join(told, "cid", "left").select("cid", "shingles", F.col("told.t").alias("tokens"), F.col("told.kind").alias("kinds"))
    signed = full.mapInArrow(_signed(percent, small_sets(percent)), "cid long, keys array<long>")
    each = saved(signed.select("cid", F.explode("keys").alias("key")), "signed")
    rows = saved(each.join(shared_keys(each), "key").join(sets, "cid"), "members")
    return linked(rows, shingles, percent)


def jaccard_join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text); linked are sets with at least ``percent`` percent of their union in common."""
    if not 50 <= percent <= 100:
        raise ValueError("between 50 and 100 percent")
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select("doc_id", "text")
    kind = dict(slim.dtypes)["doc_id"]
    scan = saved(slim.mapInArrow(_scan(shingle, part_rate(percent)), f"doc_id {kind}, n long, h1 long, h2 long, part array<long>"), "scan")
    sets, shingles = candidates(slim, scan, shingle, percent)
    links = similar(sets.select("cid", "n"), shingles, percent)
    return named_sets(scan, sets, links)


def op12(docs: DataFrame) -> DataFrame:
    return jaccard_join(docs)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id
"""
