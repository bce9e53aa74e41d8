"""Writing and reading WARC archives with boundary-chain verification.

Records are composed by column expressions and written by Spark's text writer,
whose line separator is the end mark of a record, so that archives lie in any
store that Spark writes to. They are read in splits with the record magic as
separator. A magic may also stand inside a payload: every one is a candidate,
whose header gives the offset of its successor. Tasks shorten the chains within
their split; pointer jumping over the splits, from the start of each file, finds
the true entry of every split, and only what the chain reaches is a record.
Payloads that a magic cuts in pieces are read again and put together.

Defined results: null html is an empty payload; a null id or address leaves its
header out and reads back as null; rows that repeat an id each get a record, and
if it is the greatest of its group each is a response; a broken chain keeps what
it reached; an empty table gives no rows; other columns are ignored; a payload is
one record however long it is.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.scratch import scratch_path

from .common import saved, ship

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of at least so many bytes are written once.
REVISIT_BYTES = 1000
#: Digests of repeated payloads, and places of cut records, are broadcast up to this count (some 50 bytes each).
BROADCAST_ROWS = 200_000

_LENGTH = re.compile(rb"\r\nContent-Length: (\d{1,18})(?=\r\n)", re.I)
_FIELDS = {name: re.compile(rb"\r\n" + name.encode() + rb": ([^\r\n]*)") for name in ("WARC-Page-ID", "WARC-Refers-To-Page", "WARC-Payload-Digest")}


def one_line(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def urn(name: Column) -> Column:
    uuid = F.concat_ws("-", *[F.substr(name, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))


def file_header(row: Column) -> Column:
    """The record that opens a file and says what wrote it."""
    about = "software: lectern\r\nformat: WARC File Format 1.1\r\n"
    return F.concat(
        F.lit(f"{MAGIC}WARC-Type: warcinfo\r\nWARC-Record-ID: "), urn(F.md5(F.concat_ws("|", F.lit("warcinfo"), row.cast("string")))),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n{about}"))


def record(row: Column, page_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column, refers_url: Column) -> Column:
    """A record as a string, without its end mark. row: a number of its own, for its id."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    block = F.when(refers_to.isNull(), F.concat(http, payload)).otherwise(http)
    name = F.md5(F.concat_ws("|", page_id.cast("string"), digest, row.cast("string")))

    def field(title: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{title}: "), value, F.lit("\r\n")), F.lit(""))

    return F.concat(
        F.lit(MAGIC), field("WARC-Type", F.when(refers_to.isNull(), "response").otherwise("revisit")), field("WARC-Record-ID", urn(name)),
        field("WARC-Date", F.lit(DATE)), field("WARC-Target-URI", one_line(url)), field("WARC-Page-ID", page_id.cast("string")), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        field("WARC-Profile", F.when(refers_to.isNotNull(), PROFILE)), field("WARC-Refers-To-Target-URI", F.when(refers_to.isNotNull(), one_line(refers_url))),
        field("WARC-Refers-To-Date", F.when(refers_to.isNotNull(), DATE)), field("WARC-Refers-To-Page", refers_to.cast("string")),
        field("Content-Type", F.lit("application/http;msgtype=response")), field("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)


def write_warc(pages: DataFrame, path: str) -> None:
    """Writes (page_id, url, html) as archives; one of equal large payloads is a response, the others revisit it.

    Payloads are hashed twice, once to find repeated ones and once for their record: the hashing costs less than to write
    and read them in between."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = F.octet_length(payload) >= REVISIT_BYTES
    repeated = saved(
        pages.where(large).select("page_id", "url", F.sha1(payload).alias("digest")).groupBy("digest").agg(F.max("page_id").alias("last"), F.max_by("url", "page_id").alias("last_url"), F.count("*").alias("n")).where("n > 1").select("digest", "last", "last_url"),
        "repeated")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)  # else a shuffle join, whose hot digests adaptive execution splits
    refers = F.when(F.col("last") > F.col("page_id"), F.col("last"))
    joined = rows.join(repeated, "digest", "left").withColumn("row", F.monotonically_increasing_id())
    one = record(F.col("row"), F.col("page_id"), F.col("url"), F.col("payload"), F.col("digest"), refers, F.col("last_url"))
    opens = F.col("row").bitwiseAND((1 << 33) - 1) == 0  # the first row of a task, which writes a file
    joined.select(F.when(opens, F.concat(file_header(F.col("row")), F.lit(END), one)).otherwise(one).alias("value")).write.option("lineSep", END).text(path)


def _parsed(piece: bytes) -> tuple[int, int] | None:
    """(length of the header, of the block) of what follows a magic."""
    head = piece.find(b"\r\n\r\n")
    length = _LENGTH.search(b"\r\n" + piece[: head + 2]) if head >= 0 else None
    return (head + 4, int(length[1])) if length else None


def _text(found) -> str | None:
    return found[1].decode("utf-8", "replace") if found else None


def _described(piece: bytes, head: int, whole: bool) -> dict:
    """What a record's header and, if it is whole, its payload say."""
    top = b"\r\n" + piece[:head]
    out = {k: _text(p.search(top)) for k, p in _FIELDS.items()}
    if b"\r\nWARC-Type: warcinfo\r\n" in top:
        return out | {"record_type": "warcinfo"}
    http = piece.find(b"\r\n\r\n", head) + 4
    inner = _LENGTH.search(piece, head, http) if http > 3 else None
    revisit = b"\r\nWARC-Type: revisit\r\n" in top
    digest = (out["WARC-Payload-Digest"] or "").removeprefix("sha1:")
    body = piece[http:-4]
    return {
        "page_id": out["WARC-Page-ID"], "record_type": "revisit" if revisit else "response", "refers_to": out["WARC-Refers-To-Page"],
        "payload_bytes": int(inner[1]) if revisit and inner else len(body) if whole else None,
        "payload_digest": digest if revisit else hashlib.sha1(body).hexdigest() if whole else None}


CANDIDATE = "file string, block long, pos long, span long, exit long, whole boolean, page_id string, record_type string, refers_to string, payload_bytes long, payload_digest string"
_NAMES = [f.split()[0] for f in CANDIDATE.split(", ")]


def _pieces(batches):
    """((file, block), place in the split, bytes) of what stands between two magics."""
    key, pos = None, 0
    for batch in batches:
        for file, block, value in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value"), strict=True):
            if key != (file, block):
                key, pos = (file, block), 0
            piece = value.as_py()
            yield key, pos, piece
            pos += len(piece) + len(MAGIC)


def _candidates(batches):
    split: tuple | None = None
    rows: list[dict] = []
    end = 0

    def told():
        # the chain inside the split, shortened from its end
        exits: dict[int, int] = {}
        for r in reversed(rows):
            if r["span"] is not None:
                succ = r["pos"] + r["span"] + len(MAGIC)
                r["exit"] = exits[r["pos"]] = exits.get(succ, succ)
        rows.append({"file": split[0], "block": split[1], "pos": None, "span": end})  # the split's length
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in _NAMES} for r in rows[i : i + 10_000]], SCHEMA)

    for key, pos, piece in _pieces(batches):
        if key != split:
            if split:
                yield from told()
            split, rows = key, []
        end = pos + len(piece) + len(MAGIC)
        if (pos or key[1]) and (parsed := _parsed(piece)):
            head, length = parsed
            whole = len(piece) == head + length + 4
            rows.append({"file": key[0], "block": key[1], "pos": pos, "span": head + length + 4, "whole": whole} | _described(piece, head, whole))
    if split:
        yield from told()


SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (f.split() for f in CANDIDATE.split(", "))])


def _walked(group: pa.Table) -> pa.Table:
    """The records of a split that the chain reaches from its entry."""
    rows = sorted(group.to_pylist(), key=lambda r: r["pos"])
    at, reached = None, []
    for r in rows:
        if r["entry"] or r["pos"] == at:
            at = r["pos"] + r["span"] + len(MAGIC)
            reached.append({k: v for k, v in r.items() if k != "entry"})
    return pa.Table.from_pylist(reached, pa.schema([f for f in group.schema if f.name != "entry"]))


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _joined(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: (r["piece_block"], r["piece_pos"]))
    piece = MAGIC.encode().join(r["piece"] for r in rows)[: rows[0]["span"]]
    head, _ = _parsed(piece)
    return pa.Table.from_pylist([{"file": rows[0]["file"], "block": rows[0]["block"], "pos": rows[0]["pos"]} | _described(piece, head, True)], JOINED)


PLACES = pa.schema([("file", pa.string()), ("piece_block", pa.int64()), ("piece_pos", pa.int64()), ("piece", pa.binary())])
JOINED = pa.schema([("file", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), *[f for f in SCHEMA if f.name in ("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")]])
JOINED_DDL = "file string, block long, pos long, page_id string, record_type string, refers_to string, payload_bytes long, payload_digest string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest of every record in the archives."""
    ship(spark)
    found = saved(_scan(spark, path).mapInArrow(_candidates, CANDIDATE), "candidates")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = found.where("pos is null").select("file", "block", F.coalesce(F.sum("span").over(before), F.lit(0)).alias("base"))
    # a row per candidate: offset of its first byte after the magic, and where its split's chain leaves
    nodes = saved(found.where("pos is not null").join(base, ["file", "block"]).withColumns({"at": F.col("base") + F.col("pos"), "to": F.col("base") + F.col("exit")}), "nodes")
    first = len(MAGIC)
    jump = nodes.select("file", "at", "to")
    jump = saved(jump.join(jump.select("file", F.col("to").alias("at")).union(jump.select("file", F.lit(first).cast("long"))).distinct(), ["file", "at"], "left_semi"), "jumps")
    reach = saved(jump.where(F.col("at") == first).select("file", "at"), "reached")
    size = reach.count()
    while True:
        step = reach.join(jump, ["file", "at"]).select("file", F.col("to").alias("at")).join(jump.select("file", "at"), ["file", "at"], "left_semi")
        reach = saved(reach.union(step).distinct(), "reached")
        grown = reach.count()
        if grown == size:
            break
        size = grown
        jump = saved(jump.join(jump.select("file", F.col("at").alias("to"), F.col("to").alias("then")), ["file", "to"], "left").select("file", "at", F.coalesce("then", "to").alias("to")), "jumps")
    entry = reach.withColumn("entry", F.lit(True))
    columns = ["file", "block", "pos", "span", "whole", "base", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    marked = nodes.join(entry, ["file", "at"], "left").select(*columns, F.coalesce("entry", F.lit(False)).alias("entry"))
    records = saved(marked.groupBy("file", "block").applyInArrow(_walked, CANDIDATE.replace(", exit long", "").replace("whole boolean", "whole boolean, base long")), "records")
    told = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    records = records.where("record_type <> 'warcinfo'")
    cut = records.where("not whole").select("file", "block", "pos", "span", (F.col("base") + F.col("pos")).alias("start"), (F.col("base") + F.col("pos") + F.col("span")).alias("stop"))
    if cut.isEmpty():
        return records.select(*told)

    # The splits that a cut record reaches: its own and those up to the one that holds its last byte, found in one
    # pass over a file's splits and record ends in order.
    by_block = Window.partitionBy("file").orderBy("block")
    splits = base.withColumn("number", F.row_number().over(by_block))
    ends = splits.select("file", F.col("base").alias("place"), F.col("number").alias("last"), *[F.lit(None).cast("long").alias(c) for c in ("block", "pos", "span", "start", "stop")])
    ends = ends.union(cut.select("file", F.col("stop") - 1, F.lit(None).cast("int"), "block", "pos", "span", "start", "stop"))
    upto = Window.partitionBy("file").orderBy("place", F.col("last").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("last", F.last("last", True).over(upto)).where("block is not null").join(splits.select("file", "block", F.col("number").alias("first")), ["file", "block"])
    reached = ends.select("file", "block", "pos", "span", "start", "stop", F.explode(F.sequence("first", "last")).alias("number"))
    marks = saved(reached.join(splits.select("file", F.col("block").alias("piece_block"), "base", "number"), ["file", "number"]).select(
        "file", "piece_block", F.greatest("start", "base").alias("place"), F.struct("block", "pos", "span", "stop").alias("mark")), "marks")
    wanted = marks.select("file", F.col("piece_block").alias("block")).distinct()

    def places(batches):
        # a thousand pieces or some megabytes at a time
        held, size = {"file": [], "piece_block": [], "piece_pos": [], "piece": []}, 0
        for key, pos, piece in _pieces(batches):
            for c, x in zip(held, (*key, pos, piece), strict=True):
                held[c].append(x)
            size += len(piece) + 4_000
            if size > 4_000_000:
                yield pa.RecordBatch.from_pydict(held, PLACES)
                held, size = {c: [] for c in held}, 0
        yield pa.RecordBatch.from_pydict(held, PLACES)

    # Only those splits are read again. Records don't overlap, so a piece belongs to the last mark before it.
    again = _scan(spark, path).join(wanted if wanted.count() > BROADCAST_ROWS else F.broadcast(wanted), ["file", "block"], "left_semi")
    parts = again.mapInArrow(places, "file string, piece_block long, piece_pos long, piece binary").join(base.withColumnRenamed("block", "piece_block"), ["file", "piece_block"])
    kind = marks.schema["mark"].dataType
    parts = parts.select("file", "piece_block", "piece_pos", (F.col("base") + F.col("piece_pos")).alias("place"), F.lit(None).cast(kind).alias("mark"), "piece")
    parts = parts.unionByName(marks.withColumns({"piece_pos": F.lit(None).cast("long"), "piece": F.lit(None).cast("binary")}))
    before = Window.partitionBy("file", "piece_block").orderBy("place", F.col("piece_pos").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("mark", F.last("mark", True).over(before)).where("piece is not null and place < mark.stop")
    whole = parts.select("file", "piece_block", "piece_pos", "piece", "mark.block", "mark.pos", "mark.span").groupBy("file", "block", "pos").applyInArrow(_joined, JOINED_DDL)
    return records.where("whole").select(*told).union(whole.select(*told))


def op4(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = scratch_path(spark, "archives")
    write_warc(pages, path)
    kind = dict(pages.dtypes)["page_id"]
    return read_warc(spark, path).select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND last > page_id THEN last END AS refers_to
FROM m
"""
