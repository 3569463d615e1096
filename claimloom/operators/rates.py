"""Rates, shares and descriptive tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rate_per, ratio, share
from .geography import COUNTY_MEASURES, derived_totals
from .relational import names

# Share -> (avoidable part, whole).
SHARES = {
    "ip_percent": ("avoid_ip", "total_ip"),
    "ed_percent": ("avoid_ed", "total_ed"),
    "acute_percent": ("non_emergent_acute", "total_acute"),
}
RATE_COLUMNS = (
    "avoid_ip", "total_ip", "avoid_ed", "total_ed", "non_emergent_acute", "total_acute",
)


def unit_totals(counties: DataFrame, by: str | Sequence[str] = (), measures: Sequence[str] = COUNTY_MEASURES) -> DataFrame:
    """Sum of members, months and measures per group, or overall without one."""
    columns = ("total_members", "member_month", *measures)
    return (
        counties.groupBy(*names(by))
        .agg(*[F.sum(c).alias(c) for c in columns])
        .withColumnRenamed("all_cause_acute", "total_acute")
    )


def rates(
    totals: DataFrame,
    by: str | Sequence[str] = (),
    measures: Sequence[str] = RATE_COLUMNS,
    exposure: str = "member_month",
    scale: float = 1000,
    digits: int | None = 1,
) -> DataFrame:
    """Counts per 1,000 member-months."""
    return totals.select(
        *names(by), exposure, *[rate_per(m, exposure, scale, digits).alias(m) for m in measures]
    )


def avoidable_shares(df: DataFrame, shares: Mapping[str, tuple[str, str]] = SHARES, digits: int | None = 1) -> DataFrame:
    return df.withColumns({name: share(part, whole, digits) for name, (part, whole) in shares.items()})


def utilisation(counties: DataFrame, by: str | Sequence[str] = (), rounded: bool = True) -> DataFrame:
    """Rates and avoidable shares per group.

    Published shares come from the rates already rounded; ``rounded=False``
    computes both from the counts.
    """
    totals = unit_totals(counties, by)
    return avoidable_shares(rates(totals, by, digits=1 if rounded else None), digits=1 if rounded else None)


def member_counts(
    episodes: DataFrame,
    members: DataFrame,
    keys: Sequence[str] = ("beneID", "state"),
    unit: str = "fips_code",
    months: str = "medicaidMonths",
) -> DataFrame:
    """Episode counts and avoidable shares of each member with an episode (shares 0, not NULL)."""
    classes = ("non_avoid_ip", "avoid_ip", "non_avoid_ed", "avoid_ed")
    counted = derived_totals(
        episodes.groupBy(*keys, unit).agg(*[F.sum(c).alias(c) for c in classes])
    )
    exposure = members.groupBy(*keys).agg(F.sum(months).alias("member_month"))
    shares = {**SHARES, "acute_percent": ("non_emergent_acute", "all_cause_acute")}
    return (
        avoidable_shares(counted.join(exposure, list(keys), "left"), shares)
        .drop("non_avoid_ip", "non_avoid_ed", "emergent_acute")
        .fillna(0, subset=list(shares))
    )


def describe_categories(df: DataFrame, columns: Sequence[str], digits: int = 1) -> DataFrame:
    """Count and percent of every level of every column, from one scan.

    The columns are stacked once, so a row adds one count to each of them and
    the row total is the sum of all counts over the number of columns. It is a
    scalar of the level counts, whose shuffle the plan shares.
    """
    cells = [cell for c in columns for cell in (F.lit(c), F.col(c).cast("string"))]
    levels = (
        df.select(F.stack(F.lit(len(columns)), *cells).alias("variable", "level"))
        .groupBy("variable", "level")
        .agg(F.count(F.lit(1)).alias("Count"))
    )
    rows = levels.agg((F.sum("Count") / len(columns)).alias("n")).scalar()
    return levels.withColumn("Percentage", F.round(ratio(F.col("Count"), rows, 100), digits))


def frequencies(df: DataFrame, by: str | Sequence[str], ordered: bool = False) -> DataFrame:
    """Rows per value combination, most frequent first when ordered."""
    by = names(by)
    out = df.groupBy(*by).count()
    return out.orderBy(F.desc("count"), *by) if ordered else out


def percent_meeting(df: DataFrame, condition) -> DataFrame:
    """Percent of rows meeting a condition."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100).alias("percent"),
    )
