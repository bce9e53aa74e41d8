"""JSON change pages: objects of records by id, nested objects of links and descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORDS = "map<string,string>"


def records(pages: DataFrame, column: str = "body") -> DataFrame:
    """One row per record of each page: id and its JSON object. An empty array has no records."""
    return pages.where(~F.trim(column).startswith("[")).select(F.explode(F.from_json(column, RECORDS)).alias("id", "record"))


def text(record: Column, name: str) -> Column:
    """A string or number field as trimmed text, empty if it is missing."""
    return F.coalesce(F.trim(F.get_json_object(record, f"$.{name}")), F.lit(""))


def number(record: Column, name: str) -> Column:
    return F.greatest(F.coalesce(F.get_json_object(record, f"$.{name}").try_cast("long"), F.lit(0)), F.lit(0))


def related_ids(record: Column, links: str, name: str) -> Column:
    """Ids in an object of objects, as numbers in order."""
    inner = F.map_values(F.from_json(F.get_json_object(record, f"$.{links}"), RECORDS))
    return F.sort_array(F.filter(F.transform(F.coalesce(inner, F.array().cast("array<string>")), lambda x: F.get_json_object(x, f"$.{name}").try_cast("long")), lambda x: x.isNotNull()))


def descriptors(record: Column, key: int) -> Column:
    """Values of the descriptors with a key, in map order."""
    inner = F.map_values(F.from_json(F.get_json_object(record, "$.add"), RECORDS))
    return F.transform(F.filter(F.coalesce(inner, F.array().cast("array<string>")), lambda x: F.get_json_object(x, "$.key") == str(key)), lambda x: F.coalesce(F.trim(F.get_json_object(x, "$.value")), F.lit("")))


def chunks(ids: DataFrame, size: int) -> DataFrame:
    """(id) to lookups of at most about ``size`` ids, dealt by hash."""
    n = max(1, -(-ids.count() // size))
    return ids.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(n)))
