"""From catalogue tables to one row per file: filters, links, descriptors and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import clean, isbn_list
from lectern.scratch import scratch_path

LANGUAGE_KEY, ISBN_KEY = 101, 505
EXTENSIONS = ("epub", "mobi", "azw3", "azw", "fb2", "pdf", "djvu", "txt", "rtf", "doc", "docx", "lit")
VALUE_BYTES = 64


def wanted(topic: Column, topics: tuple[str, ...]) -> Column:
    """No topics, no restriction."""
    return topic.isin(*topics) if topics else F.lit(True)


def limited(value: Column, most: int = VALUE_BYTES) -> Column:
    """Null where a value has more bytes than are kept."""
    return F.when(F.octet_length(value) <= most, value)


def keep_editions(editions: DataFrame, topics: tuple[str, ...] = ()) -> DataFrame:
    return editions.where((clean(F.col("visible")) == "") & wanted(clean(F.col("topic")), topics) & (clean(F.col("title")) != ""))


def keep_files(files: DataFrame, topics: tuple[str, ...] = (), extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    return files.where(
        wanted(clean(F.col("topic")), topics) & F.lower(clean(F.col("extension"))).isin(*extensions) & (clean(F.col("visible")) == "")
        & (F.coalesce("broken", F.lit("")) != "Y") & (F.octet_length(clean(F.col("md5"))) == 32))


def keep_descriptors(descriptors: DataFrame, editions: DataFrame, keys: tuple = (LANGUAGE_KEY, ISBN_KEY)) -> DataFrame:
    size = F.octet_length(clean(F.col("value")))
    return descriptors.where(F.col("key").isin(*keys) & (size > 0) & (size <= VALUE_BYTES)).join(editions.select("e_id"), "e_id", "left_semi")


def last_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert or replace: of the rows with a key, the last."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last")).select(*keys, "_last.*")


def first_descriptor(descriptors: DataFrame, group: str, order: str) -> DataFrame:
    return descriptors.groupBy(group).agg(F.min_by("value", order).alias("value"))


def joined_descriptors(descriptors: DataFrame, group: str, order: str, mark: str = "|") -> DataFrame:
    """All values of a group in order, as one string. A group is one edition's few descriptors."""
    seen = F.sort_array(F.collect_list(F.struct(order, "value")))
    return descriptors.groupBy(group).agg(F.array_join(F.transform(seen, lambda x: x["value"]), mark).alias("value"))


def lowest_link(links: DataFrame, editions: DataFrame) -> DataFrame:
    """f_id to the lowest id of its kept editions: filtered before the minimum is taken."""
    return links.join(editions.select("e_id"), "e_id", "left_semi").groupBy("f_id").agg(F.min("e_id").alias("e_id"))


def max_ids(files: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Highest id per topic over all rows, before any filter; topics without ids are left out."""
    highs = files.agg(*[F.max(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))).alias(t) for t, c in columns.items()])
    rows = highs.select(F.explode(F.array(*[F.struct(F.lit(t).alias("topic"), F.col(t).cast("long").alias("max_id")) for t in columns])).alias("r")).select("r.*")
    return rows.where("max_id > 0")


def resolve_key(names: DataFrame, pattern: str) -> DataFrame:
    """The key whose name holds the pattern: the shortest name, then the least key."""
    found = names.where(F.lower("name_en").contains(pattern.lower()))
    return found.agg(F.min_by("key", F.struct(F.length("name_en"), F.col("key"))).alias("key"))


def books(editions: DataFrame, descriptors: DataFrame, links: DataFrame, files: DataFrame, source: str, topics: tuple[str, ...] = (), extensions: tuple[str, ...] = EXTENSIONS, language_key: int = LANGUAGE_KEY, isbn_key: int = ISBN_KEY) -> DataFrame:
    """One row per kept file with the lowest kept edition that it links to."""
    kept = keep_editions(editions, topics)
    described = keep_descriptors(descriptors, kept, (language_key, isbn_key))
    language = first_descriptor(described.where(F.col("key") == language_key), "e_id", "seq").withColumnRenamed("value", "language")
    numbers = joined_descriptors(described.where(F.col("key") == isbn_key), "e_id", "seq").withColumnRenamed("value", "isbn")
    linked = keep_files(files, topics, extensions).join(lowest_link(links, kept), "f_id")
    of = linked.join(kept.drop("topic", "visible"), "e_id").join(language, "e_id", "left").join(numbers, "e_id", "left")
    return of.select(
        F.lower(clean(F.col("md5"))).alias("md5"), *[clean(F.col(c)).alias(n) for c, n in (("title", "title"), ("author", "author"), ("series_name", "series"), ("publisher", "publisher"), ("year", "year"))],
        F.lower(clean(F.col("language"))).alias("language"), F.lower(clean(F.col("extension"))).alias("extension"),
        *[F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0)).alias(c) for c in ("filesize", "pages")], isbn_list(F.col("isbn")).alias("isbn"), F.lit(source).alias("source"))


def stage_counts(**tables: DataFrame) -> DataFrame:
    """Rows kept per table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.union(one)
    return out


def frozen(rows: DataFrame) -> DataFrame:
    """The rows, written once: what is read several times, and from what changes meanwhile, is the same each time."""
    path = scratch_path(rows.sparkSession, "frozen")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
