"""Row-set operators shared by the domain operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_present


def names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def exclusive(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows whose key occurs exactly once; every row of a repeated key goes.

    One aggregate carries the row along with its count, so a repeated key
    shrinks to one record before the shuffle and no join back is needed.
    """
    keys = names(keys)
    rest = [c for c in df.columns if c not in keys]
    counted = (
        df.where(all_present(keys))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in rest])
    )
    return counted.where(F.col("_rows") == 1).select(*keys, *rest)


def one_row_per(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """One row per key, every other column collapsed to its maximum (NULL ignored)."""
    keys = names(keys)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in rest])


def restrict(df: DataFrame, members: DataFrame, keys: str | Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Keep the rows whose key is a member, optionally attaching member columns.

    ``members`` holds each key once, so without ``carry`` this is a semi join.
    """
    keys = names(keys)
    if not carry:
        return df.join(members.select(*keys), keys, "left_semi")
    return df.join(members.select(*keys, *carry), keys, "inner")


def enrich(df: DataFrame, other: DataFrame, keys: str | Sequence[str], fill: Mapping[str, object] | None = None) -> DataFrame:
    """Left join; columns named in ``fill`` get a constant where nothing matched."""
    out = df.join(other, names(keys), "left")
    return out.fillna(dict(fill)) if fill else out


def attach_group_stats(df: DataFrame, by: str | Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Group statistics joined back to the rows.

    The aggregate is small; adaptive execution turns the join into a broadcast
    by its measured size. A window would hold a whole group in one task.
    """
    by = names(by)
    grouped = df.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(grouped, by, "left")


def whole_levels(grouped: DataFrame, by: Sequence[str]) -> DataFrame:
    """The full grouping and the grand total of a rollup with ``_level``; ``is_total`` marks the latter."""
    total = 2 ** len(by) - 1
    return grouped.where(F.col("_level").isin(0, total)).withColumn("is_total", F.col("_level") == total).drop("_level")
