"""Cutting lineage: tables written to the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from claimloom.sources.writers import shared_folder


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table below spark.checkpoint.dir and return it as a scan; it survives the loss of executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Remove the files of a stored table that nothing will read again, to give its space to later steps."""
    spark = table.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int):
    """Let Python workers get at most `rows` rows at once in what is executed inside, for rows that may be large."""
    return _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def freed_shuffles(spark: SparkSession):
    """Remove the shuffle files of a step when it has ended; inside, every step must end in a stored table."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
