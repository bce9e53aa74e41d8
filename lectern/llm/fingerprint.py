"""Document fingerprints as invertible Bloom lookup sketches.

A text's paragraphs - lines, the long ones divided every three words - are
hashed into a set. Each element adds its digest and a check sum to three cells.
Subtracting two sketches leaves the elements in which the texts differ; peeling
cells that hold a single element recovers them, and if some are left over, the
sketches are made again four times as large. The first sketches that are
subtracted are the published fingerprints; what was recovered tells how alike
two texts are: 1 - differing / all elements of both. A fingerprint of 36 cells
alone tells some 25 differing elements, so that beyond them likeness rests on
larger sketches made from the texts.

For the next document in the order of ids, documents are dealt by ranges of ids
whose bounds are ids that occur, so that the first document of each range, which
the last of the range before needs, is known beforehand and goes to both.

Defined results: null text is empty; two texts without words are alike (1.0);
rows of equal ids stand in the order of a hash of their text; null ids come
first; a single document is its own next; an empty table gives no rows; ids may
be of any type that can be ordered; other columns are ignored; a text is handled
whole, however long.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import kernel as K
from .common import ship, shuffle_partitions

#: Cells of the fingerprint, growth at a failure, words of a paragraph's parts.
CELLS, GROWTH, PART_WORDS = 36, 4, 3
HASHES = 3
_SEED = K.U(0x5851F42D4C957F2D)


def paragraph_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct digests of each text's paragraph parts, and their n + 1 offsets."""
    found, sizes = [], [np.zeros(1, np.int64)]
    for i, j, data, at in K.chunks(pa.array(texts, pa.string())):
        t = K.Texts(data, at)
        start, end, words = t.words()
        if len(start):
            # a word's line begins at the text's or a newline's place
            lines = np.unique(np.concatenate([at[:-1], np.flatnonzero(data == 10) + 1]))
            first = np.searchsorted(start, lines)
            line = np.searchsorted(lines, start, "right") - 1
            begins = (np.arange(len(start)) - first[line]) % PART_WORDS == 0
            last = np.append(begins[1:], True)
            h, offsets = K.distinct(t.hashes(start[begins], end[last]), K.owners(words)[begins], j - i)
        else:
            h, offsets = np.zeros(0, K.U), np.zeros(j - i + 1, np.int64)
        found.append(h)
        sizes.append(np.diff(offsets))
    return (np.concatenate(found) if found else np.zeros(0, K.U)), np.cumsum(np.concatenate(sizes))


def _cells(h: np.ndarray, owner: np.ndarray, cells: int) -> list[np.ndarray]:
    third = cells // HASHES
    return [owner * cells + k * third + (K.mix64(h ^ K.U(cells * 31 + k + 1)) % K.U(third)).astype(np.int64) for k in range(HASHES)]


def sketches(h: np.ndarray, owner: np.ndarray, n: int, cells: int, sign: np.ndarray | int = 1, into=None):
    """Count, digest sum and check sum of the cells of n sketches, one after the other (sums modulo 2 ** 64)."""
    out = into or (np.zeros(n * cells, np.int64), np.zeros(n * cells, K.U), np.zeros(n * cells, K.U))
    check = K.mix64(h ^ _SEED)
    sign = np.broadcast_to(np.asarray(sign, np.int64), h.shape)
    wide = sign.astype(K.U)
    for at in _cells(h, owner, cells):
        np.add.at(out[0], at, sign)
        np.add.at(out[1], at, h * wide)
        np.add.at(out[2], at, check * wide)
    return out


def peeled(table, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sketch, digest and sign of each element recovered, whether all were) of n subtracted sketches."""
    count, digest, check = table
    found = [(np.zeros(0, np.int64), np.zeros(0, K.U), np.zeros(0, np.int64))]
    at = np.flatnonzero(np.abs(count) == 1)
    while len(at):
        sign = count[at]
        key = digest[at] * sign.astype(K.U)
        pure = (np.abs(sign) == 1) & (K.mix64(key ^ _SEED) * sign.astype(K.U) == check[at])
        owner, key, sign = at[pure] // cells, key[pure], sign[pure]
        order = np.lexsort((key, owner))
        owner, key, sign = owner[order], key[order], sign[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        owner, key, sign = owner[new], key[new], sign[new]
        if not len(key):
            break
        found.append((owner, key, sign))
        sketches(key, owner, n, cells, -sign, table)
        touched = np.unique(np.concatenate(_cells(key, owner, cells)))
        at = touched[np.abs(count[touched]) == 1]
    left = (count != 0) | (digest != 0) | (check != 0)
    return *(np.concatenate(x) for x in zip(*found, strict=True)), ~left.reshape(n, cells).any(1)


def _ranges(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of the chosen groups, and the place among the chosen of each."""
    size = at[rows + 1] - at[rows]
    member = np.arange(size.sum()) + np.repeat(at[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return member, np.repeat(np.arange(len(rows)), size)


def compared(a: tuple, a_rows: np.ndarray, b: tuple, b_rows: np.ndarray, first: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(likeness of pairs of sets, then pair, digest and sign of each element in which they differ).

    Sets are (digests, offsets). Their sketches are subtracted and peeled, in growing size. first: the fingerprints of
    all sets of a and of b, as ``sketches`` makes them, which are what is subtracted first."""
    (ha, at_a), (hb, at_b) = a, b
    size_a, size_b = at_a[a_rows + 1] - at_a[a_rows], at_b[b_rows + 1] - at_b[b_rows]
    total = size_a + size_b
    found = [(np.zeros(0, np.int64), np.zeros(0, K.U), np.zeros(0, np.int64))]
    todo, cells = np.arange(len(a_rows)), CELLS
    while len(todo):
        # so many differing elements that peeling can't end wait for a larger size
        tried = todo[np.abs(size_a - size_b)[todo] <= cells]
        failed = [np.setdiff1d(todo, tried)]
        for i in range(0, len(tried), max(1, 200_000 // cells)):
            own = tried[i : i + max(1, 200_000 // cells)]
            if first and cells == CELLS:
                table = tuple((x.reshape(-1, cells)[a_rows[own]] - y.reshape(-1, cells)[b_rows[own]]).ravel() for x, y in zip(*first, strict=True))
            else:
                ia, oa = _ranges(at_a, a_rows[own])
                ib, ob = _ranges(at_b, b_rows[own])
                table = sketches(hb[ib], ob, len(own), cells, -1, sketches(ha[ia], oa, len(own), cells))
            owner, key, sign, whole = peeled(table, len(own), cells)
            sure = whole[owner]
            found.append((own[owner[sure]], key[sure], sign[sure]))
            failed.append(own[~whole])
        todo, cells = np.concatenate(failed), cells * GROWTH
        for i in todo[cells > 400 * total[todo] + 400_000]:  # a digest collision
            x, y = ha[at_a[a_rows[i]] : at_a[a_rows[i] + 1]], hb[at_b[b_rows[i]] : at_b[b_rows[i] + 1]]
            for key, sign in ((np.setdiff1d(x, y), 1), (np.setdiff1d(y, x), -1)):
                found.append((np.full(len(key), i), key, np.full(len(key), sign)))
            todo = todo[todo != i]
    pair, key, sign = (np.concatenate(x) for x in zip(*found, strict=True))
    differ = np.bincount(pair, minlength=len(a_rows))
    return np.where(total > 0, 1 - differ / np.maximum(total, 1), 1.0), pair, key, sign


def likeness(a: tuple, a_rows: np.ndarray, b: tuple, b_rows: np.ndarray, first: tuple | None = None) -> np.ndarray:
    return compared(a, a_rows, b, b_rows, first)[0]


def encoded(table: tuple, n: int) -> list[str]:
    """Each fingerprint: its sketch as base64 of counts, digest sums and check sums."""
    count, digest, check = table
    count, digest, check = count.astype("<i4").reshape(-1, CELLS), digest.astype("<u8").reshape(-1, CELLS), (check & K.U(0xFFFFFFFF)).astype("<u4").reshape(-1, CELLS)
    return [base64.b64encode(count[i].tobytes() + digest[i].tobytes() + check[i].tobytes()).decode() for i in range(n)]


def _fingerprinted(ids: list, texts: list[str], following: list[str], with_digests: bool) -> dict:
    edited = [t[: len(t) - len(t) // 4] + x[: len(t) // 4] for t, x in zip(texts, following, strict=True)]
    n = len(texts)
    own, changed = paragraph_sets([*texts, following[-1]]), paragraph_sets(edited)
    own_sketch, changed_sketch = (sketches(h, K.owners(at), len(at) - 1, CELLS) for h, at in (own, changed))
    rows = np.arange(n)
    near, pair, key, sign = compared(own, rows, changed, rows, (own_sketch, changed_sketch))
    out = {
        "doc_id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
        "fingerprint": encoded(own_sketch, n), "edited_fingerprint": encoded(changed_sketch, n),
        "near_edited": near, "near_next": likeness(own, rows, own, rows + 1, (own_sketch, own_sketch))}
    if with_digests:
        for name, of in (("gone", 1), ("came", -1)):
            mine = np.flatnonzero(sign == of)
            mine = mine[np.lexsort((key[mine], pair[mine]))]
            out[name] = K.lists(key[mine], np.searchsorted(pair[mine], np.arange(n + 1)))
    return out


FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Characters handled at once.
RUN = 1_000_000


def _run(schema: pa.Schema):
    with_digests = "gone" in schema.names

    def run(batches):
        waiting: list[tuple] = []  # in order, of one range; the last one's successor isn't known yet
        size = 0

        def flush(keep: int):
            nonlocal waiting, size
            if len(waiting) > 1:
                out = _fingerprinted([w[1] for w in waiting[:-1]], [w[2] for w in waiting[:-1]], [w[2] for w in waiting[1:]], with_digests)
                yield pa.RecordBatch.from_pydict(out, schema)
            waiting = waiting[-1:] if keep else []
            size = 0

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("range", "doc_id", "text", "carried"))
            for at, doc_id, text, carried in zip(*columns, strict=True):
                if waiting and waiting[-1][0] != at:
                    yield from flush(0)
                if waiting and waiting[-1][3]:
                    continue  # of rows with the next range's first id only one is next
                waiting.append((at, doc_id, text or "", carried))
                size += len(text or "")
                if size > RUN or len(waiting) > 2000:
                    yield from flush(1)
        yield from flush(0)

    return run


def fingerprints(docs: DataFrame, with_digests: bool = False) -> DataFrame:
    """The fingerprint of every text, of its edited text, and their likeness; with_digests: and the paragraph digests
    that peeling recovers, ``gone`` (only in the text) and ``came`` (only in the edited text)."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType
    ranges = 4 * shuffle_partitions(spark)
    rows = docs.select("doc_id", "text")
    # The first id of each range, a row a range, and whether ids are null, which come before all others.
    ids = rows.select("doc_id").where("doc_id is not null").repartitionByRange(ranges, "doc_id").withColumn("part", F.spark_partition_id())
    firsts = sorted(r[1] for r in ids.groupBy("part").agg(F.min("doc_id")).collect())
    nulls = not rows.where("doc_id is null").isEmpty()
    least, bounds = firsts[:1], firsts[1:]
    at = carried = F.lit(0)
    if firsts:
        # how many bounds are up to the id, by halves
        known = F.array(*[F.lit(b) for b in bounds]).cast(T.ArrayType(kind))
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))]).cast("array<int>")
        at = F.aggregate(steps, F.lit(0), lambda low, s: F.when(F.coalesce(F.get(known, low + s - 1) <= F.col("doc_id"), F.lit(False)), low + s).otherwise(low)) if bounds else F.lit(0)
        first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(least[0]).cast(kind)
        # a range's first document is also the next one of the last document in the range before
        carried = F.when(first, F.lit(len(bounds))).when(F.get(known, at - 1) == F.col("doc_id"), at - 1)
    dealt = rows.withColumn("own", F.when(F.col("doc_id").isNull(), 0).otherwise(at)).withColumn("at", F.filter(F.array("own", F.coalesce(carried, F.lit(-1))), lambda x: x >= 0)).select("doc_id", "text", F.posexplode("at").alias("carried", "range"))
    dealt = dealt.select("range", F.col("carried") == 1, "doc_id", "text", F.xxhash64("text").alias("tie")).toDF("range", "carried", "doc_id", "text", "tie")
    dealt = dealt.repartition(max(1, ranges // 4), "range").sortWithinPartitions("range", "carried", "doc_id", "tie").drop("tie")
    fields = FIELDS + ", gone array<long>, came array<long>" * with_digests
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    arrow = pa.schema([("doc_id", to_arrow_type(kind)), *[(n, types[t]) for n, t in (f.split() for f in fields.split(", "))]])
    return dealt.mapInArrow(_run(arrow), f"doc_id {kind.simpleString()}, {fields}")


def op3(docs: DataFrame) -> DataFrame:
    return fingerprints(docs)
