"""County roll-up, suppression and release extracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.columns import all_above, state_prefix, total
from .classify import CLASSES
from .relational import names

# Derived totals of the four episode classes.
DERIVED_TOTALS = {
    "non_emergent_acute": ("avoid_ip", "avoid_ed"),
    "emergent_acute": ("non_avoid_ip", "non_avoid_ed"),
    "all_cause_acute": ("avoid_ip", "avoid_ed", "non_avoid_ed", "non_avoid_ip"),
    "total_ip": ("avoid_ip", "non_avoid_ip"),
    "total_ed": ("avoid_ed", "non_avoid_ed"),
}
COUNTY_MEASURES = (*CLASSES, *DERIVED_TOTALS)


def derived_totals(df: DataFrame) -> DataFrame:
    return df.withColumns({name: total(parts) for name, parts in DERIVED_TOTALS.items()})


def unit_members(members: DataFrame, unit: str | Sequence[str], member: str = "beneID", months: str = "medicaidMonths") -> DataFrame:
    return members.groupBy(*names(unit)).agg(
        F.count(member).alias("total_members"), F.sum(months).alias("member_month")
    )


def roll_up(
    members: DataFrame,
    episodes: DataFrame,
    unit: str | Sequence[str] = "fips_code",
    member: str = "beneID",
    months: str = "medicaidMonths",
    measures: Sequence[str] = CLASSES,
) -> DataFrame:
    """Members, member-months and episode counts per unit; units without episodes hold zeros."""
    unit = names(unit)
    size = unit_members(members, unit, member, months)
    counts = episodes.groupBy(*unit).agg(*[F.sum(m).alias(m) for m in measures])
    joined = size.join(counts, unit, "left").fillna(0, subset=list(measures))
    return derived_totals(joined)


def with_state_name(counties: DataFrame, crosswalk: DataFrame, unit: str = "fips_code") -> DataFrame:
    """State of a county, from the prefix of its key."""
    return counties.withColumn("fips_state", state_prefix(unit)).join(crosswalk, "fips_state", "left")


def suppress(counties: DataFrame, measures: Sequence[str] = codes.SUPPRESSED_MEASURES, limit: int = codes.SMALL_CELL) -> DataFrame:
    """Release only units with every measure above the limit; zeros and NULLs are withheld too."""
    return counties.where(all_above(measures, limit))


def release(df: DataFrame, columns: Sequence[str], rename: Mapping[str, str] = {}) -> DataFrame:
    """Projected and renamed extract for publication."""
    return df.select(*columns).withColumnsRenamed(dict(rename))


# Columns and renames of the published extracts.
UTILISATION_COLUMNS = (
    "state_name", "fips_code", "avoid_ed", "avoid_ip", "non_emergent_acute",
    "ip_percent", "ed_percent", "acute_percent",
)
UTILISATION_RENAMES = {"non_emergent_acute": "avoid_acute"}
TOTAL_SPEND_COLUMNS = (
    "fips_code", "state", "avoid_ed_cost", "avoid_ip_cost", "avoid_acute_cost", "pmpy",
)
TOTAL_SPEND_RENAMES = {"pmpy": "acute_pmpy"}
ED_SPEND_COLUMNS = ("fips_code", "state", "avoid_ed_cost", "pmpy")
ED_SPEND_RENAMES = {"pmpy": "ed_pmpy"}
IP_SPEND_COLUMNS = ("fips_code", "state", "avoid_ip_cost", "pmpy")
IP_SPEND_RENAMES = {"pmpy": "ip_pmpy"}
