"""Shared pieces of the corpus operators: tables, scratch tables and word counts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.scratch import scratch_path

#: A word is a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Number of words as a long; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def power_of_two(n: float, most: int) -> int:
    """The greatest power of two up to n and ``most``, at least 1."""
    k = 1
    while k * 2 <= n and k < most:
        k *= 2
    return k


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes the rows to a shared table and reads them back.

    Later jobs re-read the table, so a lost executor costs only its own tasks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parents[2]
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "lectern_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((top / "lectern").rglob("*.py")):
            z.write(f, f.relative_to(top))
    spark.sparkContext.addPyFile(str(path))
