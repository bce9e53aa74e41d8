"""Folders for intermediate files that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster names, else one of our own: local in local mode, in the warehouse otherwise."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if app not in _own:
        local = master.startswith("local") and not master.startswith("local-cluster")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return _own[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path, removed when the driver's JVM ends."""
    parent = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/lectern-{uuid.uuid4().hex}")
    fs = parent.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(parent)
    fs.deleteOnExit(parent)
    return f"{parent}/{tag}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """The rows as files of a new path, read back."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
