"""Finding the newest complete snapshot in a listing of dump volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.scratch import saved

PATTERN = r"^(.*?)(\d{4}-\d{2}-\d{2})\.part(\d+)\.rar$"


def snapshots(listing: DataFrame, pattern: str = PATTERN) -> DataFrame:
    """(mirror, name) to one row per mirror and day: snapshot_date, volumes, complete (volumes 1 to n, no gap)."""
    parts = listing.select("mirror", F.regexp_extract("name", pattern, 2).alias("snapshot_date"), F.regexp_extract("name", pattern, 3).alias("part")).where("part <> ''")
    return parts.groupBy("mirror", "snapshot_date").agg(F.max(F.col("part").cast("long")).alias("volumes"), F.countDistinct(F.col("part").cast("long")).alias("seen"), F.min(F.col("part").cast("long")).alias("least")).select(
        "mirror", "snapshot_date", "volumes", ((F.col("least") == 1) & (F.col("seen") == F.col("volumes"))).alias("complete"))


def newest(listing: DataFrame, pattern: str = PATTERN) -> DataFrame:
    """The newest complete snapshot of each mirror."""
    return snapshots(listing, pattern).where("complete").groupBy("mirror").agg(F.max_by(F.struct("snapshot_date", "volumes"), "snapshot_date").alias("s")).select("mirror", "s.*")


#: Names with a day and, if there are several volumes, a number.
VOLUME = r"(\d{4}-\d{2}-\d{2})(?:\.part(\d+))?\.rar$"


class SnapshotError(ValueError):
    """A listing without a snapshot, or one whose newest snapshot lacks a volume."""


def newest_volumes(listing: DataFrame, pattern: str = VOLUME) -> DataFrame:
    """snapshot_date, volume, mirror, name: the volumes of the newest day, each from the first mirror that has it.

    Mirrors add to each other, and a name without a number is volume 1. A newest
    day without all volumes from 1 on is an error: an older one is not taken in
    its place. ``listing`` is (mirror, name) and, if given, the mirrors' ``rank``."""
    rank = F.col("rank") if "rank" in listing.columns else F.col("mirror")
    # listings name a volume over and over: what is left of them is small, and they are read once
    listing = listing.select("mirror", "name", rank.alias("rank")).distinct()
    found = listing.where(F.col("name").rlike(pattern)).select(F.regexp_extract("name", pattern, 1).alias("snapshot_date"), F.coalesce(F.nullif(F.regexp_extract("name", pattern, 2), F.lit("")), F.lit("1")).cast("long").alias("volume"), F.struct("rank", "mirror", "name").alias("place"))
    found = saved(found.groupBy("snapshot_date", "volume").agg(F.min("place").alias("p")), "volumes")
    last = found.agg(F.max("snapshot_date").alias("snapshot_date"))
    volumes = found.join(F.broadcast(last), "snapshot_date", "left_semi")
    state = volumes.agg(F.count("*").alias("n"), F.min("volume").alias("low"), F.max("volume").alias("high"), F.first("snapshot_date").alias("day")).first()
    if not state["n"]:
        raise SnapshotError("no snapshot in the listing")
    if state["low"] != 1 or state["high"] != state["n"]:
        raise SnapshotError(f"the snapshot of {state['day']} lacks a volume")
    return volumes.select("snapshot_date", "volume", "p.mirror", "p.name")
