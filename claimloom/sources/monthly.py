"""Claim tables loaded month by month: a finished load is switched in by one catalogue change.

Every load is written whole to a folder of its own. Only then is the location of
the month's partition changed, so readers see the old rows or the new ones, a
write that fails changes nothing, and no other month is read or written. Folders
of replaced loads stay until they are removed, for readers that started before.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create(spark: SparkSession, name: str, schema: T.StructType, path: str, month: str = "month") -> DataFrame:
    """An empty table with the columns of `schema`, partitioned by `month`; one that exists stays as it is."""
    columns = T.StructType([f for f in schema.fields if f.name != month]).toDDL()
    spark.sql(
        f"create table if not exists {name} ({columns}, `{month}` string) using parquet "
        f"partitioned by (`{month}`) location {_text(path.rstrip('/') + '/table')}"
    )
    return spark.table(name)


def load_month(df: DataFrame, name: str, value: str, path: str, month: str = "month") -> DataFrame:
    """Put the rows of one month in place of those the table has, and return the table.

    `df` has the table's other columns with the same types, in any order; a
    month column of its own is refused, as its rows might belong elsewhere. No
    rows make the month empty. Loads of different months may run side by side;
    of two loads of one month the last to finish stays.
    """
    spark, columns = df.sparkSession, _columns(df.schema, df.sparkSession.table(name).schema, month)
    if month in df.columns:
        raise ValueError(f"{month} is given apart from the rows of one month")
    folder = _fresh(path)
    df.select(*columns).write.parquet(folder)
    _switch(spark, name, {value: folder}, month)
    return spark.table(name)


def load_months(df: DataFrame, name: str, path: str, month: str = "month") -> DataFrame:
    """The same for all months that occur in the rows, from one pass over them; other months stay.

    All are written before the first is switched in; then each changes on its
    own. A month that is null, or isn't made of letters and digits, is refused.
    """
    spark, columns = df.sparkSession, _columns(df.schema, df.sparkSession.table(name).schema, month)
    folder = _fresh(path)
    sound = F.when(F.col(month).rlike("^[0-9A-Za-z_-]+$"), F.col(month)).otherwise(F.raise_error(F.lit(f"{name}: a row has no usable {month}")))
    df.select(*columns, sound.alias(month)).hint("rebalance", month).write.partitionBy(month).parquet(folder)
    written = spark.read.schema(df.select(*columns, month).schema).parquet(folder).select(month).distinct().collect()
    _switch(spark, name, {r[0]: f"{folder}/{month}={r[0]}" for r in written}, month)
    return spark.table(name)


def _columns(given: T.StructType, table: T.StructType, month: str) -> list[str]:
    """The table's columns but for the month; the rows given must have the same ones."""
    have, wanted = ({f.name: f.dataType for f in schema.fields if f.name != month} for schema in (given, table))
    if have != wanted:
        off = sorted(n for n in have.keys() | wanted.keys() if have.get(n) != wanted.get(n))
        raise ValueError(f"columns that the table has otherwise or not at all: {', '.join(off)}")
    return list(wanted)


def _fresh(path: str) -> str:
    return f"{path.rstrip('/')}/loads/{uuid.uuid4().hex}"


def _switch(spark: SparkSession, name: str, folders: Mapping[str, str], month: str) -> None:
    for value, folder in folders.items():
        part = f"partition (`{month}` = {_text(value)})"
        spark.sql(f"alter table {name} add if not exists {part} location {_text(folder)}")
        spark.sql(f"alter table {name} {part} set location {_text(folder)}")
