"""Scans: catalog tables, month families, CSV lookups and inline tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import codes
from ..functions.columns import all_present

MONTHS = tuple(f"{m:02d}" for m in range(1, 13))

# Schemas of the lookup files, so that reading them starts no inference job.
ED_SCORE_SCHEMA = StructType(
    [StructField("dx", StringType())]
    + [
        StructField(c, DoubleType())
        for c in (
            "ednp", "pct", "nonemergent", "ednnp", "alcohol", "drug", "injury", "psych",
            "unclassified",
        )
    ]
)
IP_LIST_SCHEMA = StructType(
    [
        StructField("diagnosisOne", StringType()),
        StructField("pqiLabel", StringType()),
        StructField("icd10Label", StringType()),
        StructField("pqiNum", IntegerType()),
    ]
)
CATEGORY_SCHEMA = StructType(
    [StructField("diagnosisOne", StringType()), StructField("ccsrCatOne", StringType())]
)


def scan(
    spark: SparkSession,
    table: str,
    columns: Sequence[str] | None = None,
    keys: Sequence[str] = (),
    condition: Column | None = None,
) -> DataFrame:
    """Catalog table with projection, row filter and null-key filter, all pushed to the scan."""
    df = spark.table(table)
    return project(df, columns, keys, condition)


def project(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    keys: Sequence[str] = (),
    condition: Column | None = None,
) -> DataFrame:
    if condition is not None:
        df = df.where(condition)
    if keys:
        df = df.where(all_present(keys))
    return df.select(*columns) if columns else df


def month_family(tables: Mapping[str, DataFrame], month: str = "month") -> DataFrame:
    """Union of the tables of one family, tagged with the month each one holds."""
    tagged = [df.withColumn(month, F.lit(m)) for m, df in tables.items()]
    return reduce(DataFrame.unionByName, tagged)


def read_month_family(
    spark: SparkSession,
    template: str,
    columns: Sequence[str],
    keys: Sequence[str] = (),
    condition: Column | None = None,
    months: Iterable[str] = MONTHS,
) -> DataFrame:
    """Twelve tables named by ``template.format(month=...)`` as one dataset with a month column."""
    return month_family(
        {m: scan(spark, template.format(month=m), columns, keys, condition) for m in months}
    )


def read_lookup(
    spark: SparkSession, path: str, schema: StructType, strip: str | None = None, rejected: str | None = None
) -> DataFrame:
    """CSV lookup with a header, matched to the schema by column name.

    ``strip`` removes a wrapping character from every text value. A column the
    file lacks is an error at once, a value that is not of its column's type
    one when the row is read. With ``rejected`` such values become NULL and the
    column of that name says how many a row has.
    """
    raw = spark.read.csv(path, header=True)
    present = {c.lower(): c for c in raw.columns}
    missing = [f.name for f in schema.fields if f.name.lower() not in present]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    out, failures = [], []
    for field in schema.fields:
        value = F.col(f"`{present[field.name.lower()]}`")
        if strip:
            value = F.regexp_replace(value, f"^[{strip}]+|[{strip}]+$", "")
        cast = value.try_cast(field.dataType)
        wrong = value.isNotNull() & cast.isNull()
        if rejected is None:
            message = F.concat(F.lit(f"{field.name} in {path} is no {field.dataType.simpleString()}: "), value)
            cast = F.when(wrong, F.raise_error(message).cast(field.dataType)).otherwise(cast)
        out.append(cast.alias(field.name))
        failures.append(wrong.cast("int"))
    if rejected is not None:
        out.append(reduce(lambda a, b: a + b, failures).alias(rejected))
    return raw.select(*out)


def inline_table(spark: SparkSession, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """A small literal table, held in the plan itself: Spark knows its size and broadcasts it."""
    records = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*records)))


def state_to_fips(spark: SparkSession) -> DataFrame:
    return inline_table(spark, tuple(codes.STATE_FIPS.items()), ("state", "fips_state"))


def fips_to_state(spark: SparkSession) -> DataFrame:
    """FIPS prefix to postal code for the states proper (territories are not listed)."""
    rows = [(f, s) for s, f in codes.STATE_FIPS.items() if s not in codes.TERRITORIES]
    return inline_table(spark, rows, ("fips_state", "state_name"))
