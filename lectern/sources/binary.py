"""Reading legacy binary tables.

Fixed-width tables are read in splits of whole records, decoded a column at a
time. Tables of linked blocks are read in byte ranges, too: where blocks begin in
each is found by following candidates and checked against the range before. The
blocks of a record that lie in one range are put together there; the few others are
joined by doubling their pointers with equi-joins on the offset, and the records are
unpacked where they then lie. Definitions and index headers are a few kilobytes,
parsed on the driver.
"""

from __future__ import annotations

import itertools
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.scratch import scratch_path
from lectern.session import ship

INTEGERS, ENUM, SET, CHAR = (1, 2, 3, 8, 9, 244), 247, 248, 254
TEXTS = (15, 249, 250, 251, 252, 253, 254)
#: How fields are packed.
NORMAL, END_SPACE, PRE_SPACE, ZERO, BLOB, VARCHAR, CHECK = 0, 1, 2, 3, 4, 8, 9
#: Fixed-width records that are decoded at once.
RUN = 32_768
#: Bytes of a range of linked blocks, of what is read beyond it at once, and of its beginning that is searched for a block.
RANGE, AHEAD, WINDOW = 8 << 20, 1 << 16, 1 << 12
#: Blocks that leave a range's task at once.
BATCH = 16_384
#: Bytes of a definition or index that are looked at.
HEADER = 1 << 20


class TableError(ValueError):
    """A binary table that isn't as it should be."""


@dataclass
class ColumnDef:
    name: str
    offset: int
    length: int
    type_code: int
    labels: list[str] = field(default_factory=list)


def parse_definition(data: bytes) -> list[ColumnDef]:
    """Columns of a definition file."""
    try:
        if data[:2] != b"\xfe\x01":
            raise TableError("not a table definition")
        (names_size,) = struct.unpack_from("<H", data, 4)
        (form,) = struct.unpack_from("<I", data, 64 + names_size)
        count, screens, names_size, _, _, labels_size = (struct.unpack_from("<H", data, form + at)[0] for at in (258, 260, 268, 282, 30, 274))
        meta = form + 288 + screens
        names_at = meta + 17 * count
        names = data[names_at : names_at + names_size][1:-2].split(b"\xff")
        raw = data[names_at + names_size : names_at + names_size + labels_size]
        labels = [[x.decode("utf-8", "replace") for x in g[1:-1].split(b"\xff")] for g in raw[:-1].split(b"\0")] if raw else []
        if len(names) != count:
            raise TableError(f"{count} columns but {len(names)} names")
        out = []
        for i, name in enumerate(names):
            m = data[meta + 17 * i : meta + 17 * i + 17]
            kind = m[13]
            out.append(ColumnDef(name.decode("utf-8", "replace"), max(0, int.from_bytes(m[5:8], "little") - 1), int.from_bytes(m[3:5], "little"), kind, labels[m[12] - 1] if kind in (ENUM, SET) and m[12] else []))
        return out
    except (struct.error, IndexError) as e:
        raise TableError("truncated table definition") from e


@dataclass
class FieldDef:
    """How a stretch of the record is packed, and the bit that marks it as null (0: none)."""

    kind: int
    length: int
    null_bit: int = 0
    null_pos: int = 0


@dataclass
class Layout:
    linked: bool
    rows: int
    width: int
    #: Bytes of the packing bitmap, whether a checksum byte ends a record, and the stretches in order.
    bitmap: int = 0
    checksum: bool = False
    fields: list[FieldDef] = field(default_factory=list)

    def by_offset(self) -> dict[int, FieldDef]:
        starts = itertools.accumulate((f.length for f in self.fields), initial=0)
        return dict(zip(starts, self.fields, strict=False))


def parse_index_header(data: bytes) -> Layout:
    """Whether records are linked blocks, how many there are and their width."""
    if data[:4] != b"\xfe\xfe\x07\x01" or len(data) < 32:
        raise TableError("not an index header")
    options, header, base = (struct.unpack_from(">H", data, at)[0] for at in (4, 6, 12))
    if header > len(data) or base + 100 > header or base < 36:
        raise TableError("truncated index header")
    (rows,) = struct.unpack_from(">Q", data, 28)
    (width,) = struct.unpack_from(">I", data, base + 44)
    if options & 4:
        raise TableError("packed tables are not supported")
    if not 0 < width <= 1_000_000:
        raise TableError("implausible record width")
    try:
        at = base + struct.unpack_from(">H", data, 10)[0]
        # definitions of keys and unique constraints come first, each with its segments
        for many, size in ((data[18], 12), (data[19], 4)):
            for _ in range(many):
                at += size + 18 * data[at]
        (count,), (bitmap,) = struct.unpack_from(">I", data, base + 64), struct.unpack_from(">H", data, base + 76)
        if at + 7 * count > header:
            raise TableError("field definitions exceed the index header")
        fields = [FieldDef(*struct.unpack_from(">hHBH", data, at + 7 * i)) for i in range(count)]
    except (struct.error, IndexError) as e:
        raise TableError("truncated index header") from e
    if sum(f.length for f in fields) != width:
        raise TableError(f"fields of {sum(f.length for f in fields)} bytes in records of {width}")
    return Layout(bool(options & 1), rows, width, bitmap, bool(options & 32), fields)


def scalar(b: bytes, c: ColumnDef):
    """A column's bytes as the value that a text dump would show."""
    if c.type_code in TEXTS:
        text = b.decode("utf-8", "replace")
        return text.rstrip(" ") if c.type_code == CHAR else text
    if c.type_code not in (*INTEGERS, ENUM, SET):
        raise TableError(f"values of type {c.type_code} in {c.name} are not supported")
    n = int.from_bytes(b, "little")
    if len(b) > 8 or n >= 2**63:
        raise TableError(f"{c.name} holds a number of over 63 bits")
    if c.type_code == ENUM:
        if n > len(c.labels):
            raise TableError(f"{c.name} has no label {n}")
        return c.labels[n - 1] if n else ""
    if c.type_code == SET:
        if n >> len(c.labels):
            raise TableError(f"{c.name} has no labels for {n}")
        return ",".join(x for i, x in enumerate(c.labels) if n >> i & 1)
    return n


def chosen(columns: list[ColumnDef], select: list[str] | None) -> list[ColumnDef]:
    """The named columns in the table's order; a name that isn't there is an error."""
    missing = set(select or ()) - {c.name for c in columns}
    if missing:
        raise TableError(f"no columns {sorted(missing)}")
    return [c for c in columns if select is None or c.name in select]


def schema_of(columns: list[ColumnDef]) -> pa.Schema:
    return pa.schema([(c.name, pa.int64() if c.type_code in INTEGERS else pa.string()) for c in columns])


def ddl(columns: list[ColumnDef]) -> str:
    return ", ".join(f"`{c.name}` {'long' if c.type_code in INTEGERS else 'string'}" for c in columns)


def _fixed_column(data: np.ndarray, c: ColumnDef, f: FieldDef | None) -> pa.Array:
    """A column of whole records, a record a row of bytes."""
    cells = np.ascontiguousarray(data[:, c.offset : c.offset + c.length])
    null = (data[:, f.null_pos] & f.null_bit) != 0 if f and f.null_bit else np.zeros(len(data), bool)
    cells[null] = 0
    if c.type_code in TEXTS or c.length > 8:
        return pa.array([None if gone else scalar(cell.tobytes(), c) for cell, gone in zip(cells, null, strict=True)], pa.string())
    wide = np.zeros((len(cells), 8), np.uint8)
    wide[:, : c.length] = cells
    numbers = wide.view("<i8").ravel()
    if c.type_code in INTEGERS and (not len(numbers) or numbers.min() >= 0):
        return pa.array(numbers, mask=null)
    # few distinct values: each is decoded once
    values, which = np.unique(numbers, return_inverse=True)
    return pa.array([scalar(v.tobytes(), c) for v in values], pa.string()).take(pa.array(which, mask=null))


def read_fixed(spark: SparkSession, path: str, columns: list[ColumnDef], layout: Layout, select: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a fixed-width table; records that begin with a zero byte are deleted, null bits are kept as nulls.

    Splits hold whole records; they travel in runs, and each run is decoded a column at a time."""
    if layout.linked:
        raise TableError("records of this table are linked blocks")
    ship(spark)
    width, wanted, fields = layout.width, chosen(columns, select), layout.by_offset()
    schema = schema_of(wanted)

    def runs(records):
        while run := b"".join(itertools.islice(records, RUN)):
            yield (bytearray(run),)

    def decode(batches):
        for batch in batches:
            for run in batch.column("run"):
                data = np.frombuffer(run.as_buffer(), np.uint8).reshape(-1, width)
                data = data[data[:, 0] != 0]
                yield pa.RecordBatch.from_arrays([_fixed_column(data, c, fields.get(c.offset)) for c in wanted], schema=schema)

    rows = spark.createDataFrame(spark.sparkContext.binaryRecords(path, width).mapPartitions(runs), "run binary").mapInArrow(decode, ddl(wanted))
    return rows.limit(limit) if limit is not None else rows


#: Block types as (first block, bytes of the record's length, of the block's length, of padding, has a pointer).
BLOCKS = {
    1: (True, 0, 2, 0, False), 2: (True, 0, 3, 0, False), 3: (True, 0, 2, 1, False), 4: (True, 0, 3, 1, False), 5: (True, 2, 2, 0, True), 6: (True, 3, 3, 0, True), 13: (True, 4, 3, 0, True),
    7: (False, 0, 2, 0, False), 8: (False, 0, 3, 0, False), 9: (False, 0, 2, 1, False), 10: (False, 0, 3, 1, False), 11: (False, 0, 2, 0, True), 12: (False, 0, 3, 0, True),
}


class Stretch:
    """A file's bytes from ``lo`` on, read further as they are asked for."""

    def __init__(self, uri: str, lo: int, hi: int, length: int):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri)
        self.lo, self.length = lo, length
        self._file = system.open_input_file(path)
        self._file.seek(lo)
        self.data = self._file.read(min(hi + AHEAD, length) - lo)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self._file.close()

    def __call__(self, at: int, end: int) -> bytes:
        if end > self.length:
            raise TableError(f"bad block length at {at}")
        if end - self.lo > len(self.data):
            self.data += self._file.read(max(end - self.lo - len(self.data), AHEAD))
        return self.data[at - self.lo : end - self.lo]


def block_at(read, pos: int):
    """(first, record length, payload's place and size, pointer or None, following offset) of the block at ``pos``; first is None for a deleted one."""
    kind = read(pos, pos + 1)[0]
    if kind == 0:
        size = int.from_bytes(read(pos + 1, pos + 4), "big")
        if not size or pos + size > read.length:
            raise TableError(f"bad block length at {pos}")
        return None, 0, 0, 0, None, pos + size
    if kind not in BLOCKS:
        raise TableError(f"unknown block type {kind} at {pos}")
    first, record, length, padding, pointed = BLOCKS[kind]
    head = read(pos + 1, pos + 1 + record + length + padding + 8 * pointed)
    whole, size = int.from_bytes(head[:record], "big"), int.from_bytes(head[record : record + length], "big")
    pad = head[record + length] if padding else 0
    pointer = int.from_bytes(head[record + length :], "big") if pointed else 2**64 - 1
    at = pos + 1 + len(head)
    if not size or at + size + pad > read.length:
        raise TableError(f"bad block length at {pos}")
    return first, (whole or size) if first else 0, at, size, None if pointer == 2**64 - 1 else pointer, at + size + pad


class Held:
    """Bytes that are at hand, read like a stretch of a file."""

    def __init__(self, data: bytes):
        self.data, self.length = data, len(data)

    def __call__(self, at: int, end: int) -> bytes:
        if end > self.length:
            raise TableError(f"bad block length at {at}")
        return self.data[at:end]


def blocks_of(data: bytes):
    """(offset, first, record length, payload, pointer or the following offset) of every block in use."""
    read, at = Held(data), 0
    while at < len(data):
        first, record, place, size, pointer, following = block_at(read, at)
        if first is not None:
            yield at, first, record, read(place, place + size), following if pointer is None else pointer
        at = following


def _enter(read, lo: int, hi: int) -> tuple[list[int], int | None]:
    """Places near ``lo`` from which blocks follow each other up to ``hi``, those of the chain that most lead to, and where it goes on behind ``hi``."""
    chains: dict[int, list[int]] = {}
    leads: dict[int, int] = {}
    for start in range(lo, min(hi, lo + WINDOW)):
        at, path = start, []
        try:
            while at < hi and at not in leads:
                path.append(at)
                at = block_at(read, at)[-1]
        except TableError:
            continue
        out = leads.get(at, at)
        leads.update((x, out) for x in path)
        chains.setdefault(out, []).append(start)
    if not chains:
        return [], None
    out = max(chains, key=lambda x: len(chains[x]))
    return chains[out], out


def _follow(read, at: int, hi: int) -> int:
    while at < hi:
        at = block_at(read, at)[-1]
    return at


def ranges(spark: SparkSession, path: str, size: int = 0) -> list[tuple[str, int, int, int]]:
    """(file, length, start, end) of the ranges that files are read in."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files = []
    for status in system.globStatus(hadoop) or []:
        for f in system.listStatus(status.getPath()) if status.isDirectory() else [status]:
            if f.isFile() and f.getLen() and not f.getPath().getName().startswith(("_", ".")):
                files.append((f.getPath().toString(), f.getLen()))
    size = size or RANGE
    return [(uri, n, lo, min(lo + size, n)) for uri, n in sorted(files) for lo in range(0, n, size)]


def entries(spark: SparkSession, parts: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """(file, length, start, end, first block's place) of the ranges that blocks begin in.

    Where a block begins is known from the one before only. Each range's task finds the places near its start that a
    chain of blocks may be entered at, and where that chain leaves it; the ranges are then put in order by these few
    numbers, and one whose true entry isn't among its places is walked again from there."""

    def look(batches):
        for batch in batches:
            rows = []
            for uri, n, lo, hi, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with Stretch(uri, lo, hi, n) as read:
                    rows.append((uri, lo, *(([at], _follow(read, at, hi)) if at is not None else _enter(read, lo, hi))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.int64())], ["file", "lo", "at", "out"])

    found: dict[tuple[str, int], tuple[list[int], int | None]] = {}
    todo = [(*p, 0 if p[2] == 0 else None) for p in parts]
    while todo:
        frame = spark.createDataFrame(todo, "file string, n long, lo long, hi long, at long").repartition(len(todo))
        for r in frame.mapInArrow(look, "file string, lo long, at array<long>, out long").collect():  # a few numbers a range
            found[r["file"], r["lo"]] = (list(r["at"]), r["out"])
        out, todo, at, stopped = [], [], {}, set()
        for uri, n, lo, hi in parts:
            here = at.get(uri, 0)
            if uri in stopped or here >= hi:
                continue
            if here not in found[uri, lo][0]:
                todo.append((uri, n, lo, hi, here))
                stopped.add(uri)
                continue
            out.append((uri, n, lo, hi, here))
            at[uri] = found[uri, lo][1]
    return out


def _pieces(read, at: int, hi: int):
    """(at, first, record size, payload, next) of the blocks from ``at`` to ``hi``, those of a record put together as far as they lie here."""
    heads, rest = [], {}
    while at < hi:
        first, record, place, size, pointer, following = block_at(read, at)
        if first:
            heads.append((at, record, read(place, place + size), following if pointer is None else pointer))
        elif first is not None:
            rest[at] = (read(place, place + size), following if pointer is None else pointer)
        at = following
    used = set()

    def onward(start: int, have: list[bytes], to: int, enough: int | None):
        n = sum(map(len, have))
        while (enough is None or n < enough) and to in rest:
            if to in used:
                raise TableError(f"two records meet in the block at {to}")
            used.add(to)
            part, then = rest[to]
            have.append(part)
            n, to = n + len(part), then
        if enough is not None and n > enough:
            raise TableError(f"more bytes than the record has at {start}")
        return b"".join(have), to

    for start, record, payload, to in heads:
        whole, to = onward(start, [payload], to, record)
        yield start, True, record, whole, to
    # what records of other ranges may go on with, block by block: they may end or meet in any of them
    for start in sorted(rest.keys() - used):
        yield start, False, 0, *rest[start]


def read_blocks(spark: SparkSession, path: str, range_size: int = 0) -> DataFrame:
    """file, at, first, record_size, payload, next: the blocks in use, in ranges of files; a record's blocks that lie in one range are one."""
    ship(spark)
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("first", pa.bool_()), ("record_size", pa.int64()), ("payload", pa.binary()), ("next", pa.int64())])

    def run(batches):
        for batch in batches:
            for uri, n, lo, hi, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with Stretch(uri, lo, hi, n) as read:
                    pieces = _pieces(read, at, hi)
                    while rows := list(itertools.islice(pieces, BATCH)):
                        yield pa.RecordBatch.from_arrays([pa.array([uri] * len(rows)), *map(pa.array, zip(*rows, strict=True), schema.types[1:])], schema=schema)

    parts = entries(spark, ranges(spark, path, range_size))
    frame = spark.createDataFrame(parts, "file string, n long, lo long, hi long, at long")
    return frame.repartition(max(1, len(parts))).mapInArrow(run, "file string, at long, first boolean, record_size long, payload binary, next long")


def scan_statistics(spark: SparkSession, path: str, range_size: int = 0) -> DataFrame:
    """file, records, fragmented_records, continuation_blocks, deleted_blocks, bytes of tables of linked blocks, from the blocks' heads."""
    ship(spark)
    names = ["records", "fragmented_records", "continuation_blocks", "deleted_blocks", "bytes"]

    def run(batches):
        for batch in batches:
            rows = []
            for uri, n, lo, hi, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts, start = [0] * 4, at
                with Stretch(uri, lo, hi, n) as read:
                    while at < hi:
                        first, record, _, size, _, at = block_at(read, at)
                        counts[0] += first is True
                        counts[1] += first is True and size < record
                        counts[2] += first is False
                        counts[3] += first is None
                rows.append((uri, *counts, at - start))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i + 1] for r in rows], pa.int64()) for i in range(5))], ["file", *names])

    parts = entries(spark, ranges(spark, path, range_size))
    frame = spark.createDataFrame(parts, "file string, n long, lo long, hi long, at long").repartition(max(1, len(parts)))
    return frame.mapInArrow(run, "file string, " + ", ".join(f"{n} long" for n in names)).groupBy("file").agg(*[F.sum(n).alias(n) for n in names])


def read_linked(spark: SparkSession, path: str, range_size: int = 0) -> DataFrame:
    """file, at, record: the records of a table of linked blocks, their parts joined by pointer.

    Most records lie in one range of their file and are whole when it is read. Of
    the others, pointers are doubled until the longest record is covered, then every
    record is divided into its blocks, half by half; both take the logarithm of the
    most parts in steps. Each part adds a byte at least, so this ends."""

    def saved(df: DataFrame, tag: str) -> DataFrame:
        where = scratch_path(spark, tag)
        df.write.parquet(where)
        return spark.read.schema(df.schema).parquet(where)

    try:
        blocks = saved(read_blocks(spark, path, range_size), "blocks")
    except PythonException as e:
        # what a task found wrong with the table
        said = re.search(r"TableError: (.*)", str(e))
        raise (TableError(said[1]) if said else e) from e

    def exactly(record, found, at: str):
        return F.when(found == F.col("record_size"), record).otherwise(F.raise_error(F.concat(F.lit("more bytes than the record has at "), F.col(at).cast("string"))))

    size = F.octet_length("payload")
    whole = blocks.where("first").where(size >= F.col("record_size")).select("file", "at", exactly(F.col("payload"), size, "at").alias("record"))
    open_ = saved(blocks.where("first").where(F.octet_length("payload") < F.col("record_size")).select("file", F.col("at").alias("head"), "record_size"), "open")
    if open_.isEmpty():
        return whole
    # step: where 2^i blocks from a block on end, null if a block is missing before, and their bytes
    step = blocks.select("file", F.col("at"), F.col("next").alias("to"), F.octet_length("payload").cast("long").alias("bytes"))
    rest = blocks.where(~F.col("first")).select("file", F.col("at").alias("to"))
    step = saved(step.join(rest, ["file", "to"], "left_semi").unionByName(step.join(rest, ["file", "to"], "left_anti").withColumn("to", F.lit(None).cast("long"))), "step")
    steps = [step]
    while True:
        reached = open_.join(steps[-1].withColumnRenamed("at", "head"), ["file", "head"])
        short = reached.where("bytes < record_size")
        if short.where("to is not null").isEmpty():
            break
        a, b = steps[-1], steps[-1].select("file", F.col("at").alias("to"), F.col("to").alias("then"), F.col("bytes").alias("more"))
        steps.append(saved(a.join(b, ["file", "to"], "left").select("file", "at", F.col("then").alias("to"), (F.col("bytes") + F.coalesce("more", F.lit(0))).alias("bytes")), "step"))
    broken = short.limit(1).collect()
    if broken:
        raise TableError(f"a missing continuation of the record at {broken[0]['head']}")
    parts = open_.select("file", "head", "record_size", F.col("head").alias("at"), F.lit(0).cast("long").alias("offset"))
    for step in reversed(steps[:-1]):
        onward = parts.join(step, ["file", "at"]).where(F.col("to").isNotNull() & (F.col("offset") + F.col("bytes") < F.col("record_size")))
        parts = saved(parts.unionByName(onward.select("file", "head", "record_size", F.col("to").alias("at"), (F.col("offset") + F.col("bytes")).alias("offset"))), "parts")
    shared = parts.groupBy("file", "at").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if shared:
        raise TableError(f"two records meet in the block at {shared[0]['at']}")
    placed = parts.join(blocks.select("file", "at", "payload"), ["file", "at"]).groupBy("file", "head", "record_size").agg(F.sum(size).alias("found"), F.sort_array(F.collect_list(F.struct("offset", "payload"))).alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["payload"])), ""))
    return whole.unionByName(placed.select("file", F.col("head").alias("at"), exactly(joined, F.col("found"), "head").alias("record")))


def unpack(record: bytes, layout: Layout) -> list[tuple[int, bytes | None]]:
    """(offset, bytes or None) of every stretch of a packed record, each checked whether it is asked for or not."""
    pos, flags, at, nulls, out = layout.bitmap, 0, 0, bytearray(layout.width), []
    if len(record) < pos:
        raise TableError("truncated packing bitmap")

    def take(n: int) -> bytes:
        nonlocal pos
        pos += n
        if pos > len(record):
            raise TableError(f"truncated field at {pos - n}")
        return record[pos - n : pos]

    for f in layout.fields:
        packed = False
        if f.kind in (END_SPACE, PRE_SPACE, ZERO, BLOB):
            if flags >= 8 * layout.bitmap:
                raise TableError("more fields than the packing bitmap has")
            packed = bool(record[flags // 8] >> flags % 8 & 1)
            flags += 1
        if f.kind == ZERO and packed:
            value = bytes(f.length)
        elif f.kind in (NORMAL, CHECK, ZERO):
            value = take(f.length)
        elif f.kind in (END_SPACE, PRE_SPACE):
            size = f.length
            if packed:
                size = take(1)[0]
                if f.length > 255 and size & 128:
                    size = (size & 127) + (take(1)[0] << 7)
            if size > f.length:
                raise TableError(f"a text of {size} bytes in a field of {f.length}")
            value = take(size)
            value = value.ljust(f.length) if f.kind == END_SPACE else value.rjust(f.length)
        elif f.kind == BLOB:
            if not 9 <= f.length <= 12:
                raise TableError(f"a long text with a slot of {f.length} bytes")
            value = b"" if packed else take(int.from_bytes(take(f.length - 8), "little"))
        elif f.kind == VARCHAR:
            short = f.length <= 256
            size = take(1)[0]
            if not short and size == 255:
                size = int.from_bytes(take(2), "big")
            if size > f.length - (1 if short else 2):
                raise TableError(f"a text of {size} bytes in a field of {f.length}")
            value = take(size)
        else:
            raise TableError(f"unknown packing {f.kind}")
        if f.kind in (NORMAL, CHECK):
            # null bits lie in stretches of their own before the columns they speak of
            nulls[at : at + f.length] = value
        out.append((at, None if f.null_bit and nulls[f.null_pos] & f.null_bit else value))
        at += f.length
    if pos + layout.checksum != len(record):
        raise TableError(f"a record of {len(record)} bytes has fields of {pos}")
    return out


def read_rows(spark: SparkSession, path: str, columns: list[ColumnDef], layout: Layout, select: list[str] | None = None, value_limit: int | None = None) -> DataFrame:
    """Rows of a table of linked blocks, columns decoded; values of more bytes than ``value_limit`` become null."""
    if not layout.linked:
        raise TableError("records of this table have a fixed width")
    wanted = chosen(columns, select)
    schema, starts = schema_of(wanted), layout.by_offset()
    for c in columns:
        if c.offset not in starts:
            raise TableError(f"the record's fields don't cover {c.name}")
    if hidden := [at for at, f in starts.items() if f.kind not in (NORMAL, CHECK) and at not in {c.offset for c in columns}]:
        raise TableError(f"no column for the packed field at {hidden[0]}")

    def decode(batches):
        for batch in batches:
            rows = [{at: v for at, v in unpack(r, layout) if v is not None and (value_limit is None or len(v) <= value_limit)} for r in batch.column("record").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([scalar(r[c.offset], c) if c.offset in r else None for r in rows], schema.field(c.name).type) for c in wanted], schema=schema)

    return read_linked(spark, path).select("record").mapInArrow(decode, ddl(wanted))


def describe(spark: SparkSession, folder: str, name: str) -> tuple[list[ColumnDef], Layout, str]:
    """Columns, layout and data file of the table ``name``, from its definition and the beginning of its index."""
    files = {}
    for ending in ("frm", "MYI", "MYD"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}.{ending}")
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            raise TableError(f"no {name}.{ending} in {folder}")
        files[ending] = (system.makeQualified(path).toString(), system.getFileStatus(path).getLen())

    def beginning(ending: str) -> bytes:
        with Stretch(files[ending][0], 0, HEADER, files[ending][1]) as read:
            return read.data

    return parse_definition(beginning("frm")), parse_index_header(beginning("MYI")), files["MYD"][0]


def read_table(spark: SparkSession, folder: str, name: str, select: list[str] | None = None, value_limit: int | None = None) -> tuple[DataFrame, Layout]:
    """Rows of a table by its three files, and its layout. value_limit: of a column's bytes, padding included, beyond which a value is null."""
    columns, layout, path = describe(spark, folder, name)
    if layout.linked:
        return read_rows(spark, path, columns, layout, select, value_limit), layout
    rows = read_fixed(spark, path, columns, layout, select)
    if value_limit is not None:
        wide = {c.name for c in columns if c.length > value_limit}
        rows = rows.select(*[F.lit(None).cast(t).alias(c) if c in wide else F.col(c) for c, t in rows.dtypes])
    return rows, layout


def check_rows(df: DataFrame, layout: Layout) -> DataFrame:
    """The rows, if they are as many as the header says."""
    n = df.count()
    if n != layout.rows:
        raise TableError(f"{n} rows where the header says {layout.rows}")
    return df
