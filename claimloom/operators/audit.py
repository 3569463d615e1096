"""Audits: coverage, missingness and match rates as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_missing
from .relational import names


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing) for each column, counted in one pass."""
    types = dict(df.dtypes)
    columns = list(columns or df.columns)
    counts = df.agg(*[F.count_if(is_missing(c, types[c])).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "missing")


def coverage(df: DataFrame, by: str | Sequence[str] = "state") -> DataFrame:
    """Rows per group; the number of rows returned is the number of groups."""
    return df.groupBy(*names(by)).count()


def match_rate(joined: DataFrame, matched: str) -> DataFrame:
    """Rows, matched rows and percent matched after an enriching left join."""
    return joined.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(matched).alias("matched"),
        (F.avg(matched) * 100).alias("percent_matched"),
    )
