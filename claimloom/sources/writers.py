"""Sinks: managed tables, CSV releases and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def save_table(df: DataFrame, name: str, partition_by: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """Overwrite a table and return it as a new scan, so later plans start from the files.

    A partitioned table is rebalanced on its partition columns first: every
    folder gets few, evenly sized files, and a large partition value is split
    over many tasks.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def save_buckets(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """Overwrite a table bucketed and sorted by keys; joins and aggregates on them read it without an exchange.

    Rows are dealt by the same hash first, so every bucket is one file. Choose
    `buckets` by size (about the bytes of the larger side over 256 MB) and the
    same for every table that is joined; a bucket is one task of such a join.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.format("csv").option("header", "true").mode("overwrite").save(path)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    A session in one process without that setting (tests) gets a temporary
    folder; a cluster, `local-cluster` too, must name the shared folder itself.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        base = tempfile.mkdtemp(prefix="claimloom-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Written to the shared folder and read again: for what is read several times."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
