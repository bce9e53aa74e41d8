"""Reading relational text dumps (CREATE TABLE and extended INSERT statements).

A statement's rows stand on one line, so lines are the unit that Spark splits a
dump into; gzip dumps are read as they are. Columns come from the CREATE TABLE
lines, a few per table. Only lines of the wanted table reach the tuple parser.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import ship

#: Escapes with a meaning of their own; any other character stands for itself.
ESCAPES = {"0": "\0", "n": "\n", "r": "\r", "t": "\t", "b": "\b", "Z": "\x1a"}
_ESCAPE = re.compile(r"\\(.)|''", re.S)
_VALUE = re.compile(r"\s*(?:'((?:[^'\\]|\\.|'')*)'|([^,()'\s][^,()']*))\s*([,)])", re.S)


class DumpError(ValueError):
    """A dump that isn't as it should be."""


def dump_lines(spark: SparkSession, path: str) -> DataFrame:
    # the default separator would also break lines at a bare \r inside a value
    return spark.read.option("lineSep", "\n").text(path)


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and its place in the dump: file, where its split begins, and a number that grows within a split.

    Spark deals the splits of a dump out by size, so that the number alone doesn't follow the dump."""
    return dump_lines(spark, path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def definitions(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Column names in order of every table that the dump defines, in one pass."""
    ddl = placed_lines(spark, path).where(F.col("value").rlike(r"^(CREATE TABLE |\s+`)")).orderBy("file", "block", "line").collect()  # a dump's few definitions
    found: dict[str, list[str]] = {}
    current = None
    for r in ddl:
        if m := re.match(r"CREATE TABLE (?:IF NOT EXISTS )?`([^`]+)`", r["value"]):
            current = found.setdefault(m[1], [])
        elif (m := re.match(r"\s+`([^`]+)`", r["value"])) and current is not None:
            current.append(m[1])
    return found


def tuples(line: str, width: int):
    """The rows of an INSERT line as lists of strings and None."""
    pos = line.index("VALUES") + 6
    while True:
        while pos < len(line) and line[pos] in " \t\r,":
            pos += 1
        if pos >= len(line) or line[pos] == ";":
            return
        if line[pos] != "(":
            raise DumpError(f"a row was expected at {pos}")
        pos += 1
        row: list[str | None] = []
        while True:
            m = _VALUE.match(line, pos)
            if not m:
                raise DumpError(f"an unterminated value or row at {pos}")
            text, bare, mark = m.groups()
            row.append(_ESCAPE.sub(lambda e: "'" if e[1] is None else ESCAPES.get(e[1], e[1]), text) if bare is None else None if bare.strip().upper() == "NULL" else bare.strip())
            pos = m.end()
            if mark == ")":
                break
        if len(row) != width:
            raise DumpError(f"{len(row)} values for {width} columns")
        yield row


#: Columns of a row's place in a dump, in the order that they sort by.
PLACE = ("_file", "_block", "_line", "_row")


def read_dump(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, limit: int | None = None, defined: dict[str, list[str]] | None = None, with_place: bool = False) -> DataFrame:
    """The rows of a table as strings; ``columns`` chooses and orders them.

    defined: the dump's definitions, if they are known; with_place: adds each row's place in the dump (``PLACE``)."""
    ship(spark)
    defined = defined if defined is not None else definitions(spark, path)
    if table not in defined:
        raise DumpError(f"no CREATE TABLE for {table}")
    names = defined[table]
    missing = set(columns or []) - set(names)
    if missing:
        raise DumpError(f"{table} has no column {', '.join(sorted(missing))}")
    chosen = [names.index(c) for c in columns or names]
    head = re.compile(rf"^INSERT INTO `{re.escape(table)}`")
    place = [(c, pa.string() if c == "_file" else pa.int64()) for c in PLACE] if with_place else []
    schema = pa.schema([*[(names[i], pa.string()) for i in chosen], *place])

    def run(batches):
        for batch in batches:
            for k, line in enumerate(batch.column("value").to_pylist()):
                if head.match(line):
                    rows = list(tuples(line, len(names)))
                    at = [pa.array([batch.column(c)[k].as_py()] * len(rows), t) for c, (_, t) in zip(("file", "block", "line"), place, strict=False)]
                    yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], pa.string()) for i in chosen], *at, *[pa.array(range(len(rows)), t) for _, t in place[3:]]], schema=schema)

    wanted = placed_lines(spark, path).where(F.col("value").startswith(f"INSERT INTO `{table}`"))
    out = wanted.mapInArrow(run, ", ".join([f"`{names[i]}` string" for i in chosen] + [f"{c} {'string' if c == '_file' else 'long'}" for c, _ in place]))
    return out.limit(limit) if limit is not None else out


def quoted(c: Column) -> Column:
    """A value as a dump literal."""
    text = c.cast("string")
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0"), ("\x1a", "\\Z")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("NULL"))


def write_dump(df: DataFrame, table: str, path: str, rows: int = 25) -> None:
    """Writes a dump: a folder with the definition in one file and the rows, so many a statement, in others."""
    ddl = "\n".join([f"CREATE TABLE `{table}` (", *[f"  `{c}` text," for c in df.columns], ");"])
    df.sparkSession.range(1, numPartitions=1).select(F.lit(ddl).alias("value")).write.option("lineSep", "\n").text(path)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pydict({"value": [f"INSERT INTO `{table}` VALUES " + ",".join(batch.column("value").slice(i, rows).to_pylist()) + ";"]})

    one = F.concat(F.lit("("), F.concat_ws(",", *[quoted(F.col(c)) for c in df.columns]), F.lit(")"))
    df.select(one.alias("value")).mapInArrow(run, "value string").write.mode("append").option("lineSep", "\n").text(path)
