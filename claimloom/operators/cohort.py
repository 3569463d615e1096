"""Study cohort: member selection, exclusion funnel, scoped claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.columns import all_present, county_key
from .prefilter import restrict_early
from .relational import exclusive, names, one_row_per, restrict

MEMBER_KEYS = ("beneID", "state")


def single_state_members(demo: DataFrame, member: str | Sequence[str] = "beneID") -> DataFrame:
    """Members seen in exactly one state; anyone seen twice is left out altogether."""
    return exclusive(demo, member)


def without_states(df: DataFrame, states: Sequence[str] = codes.EXCLUDED_STATES, state: str = "state") -> DataFrame:
    return df.where(~F.col(state).isin(*states))


def eligible(members: DataFrame, age_limit: int = 65, dual_months: str = "medicareMonths", age: str = "age") -> DataFrame:
    """No month of dual eligibility and below the age limit; unknowns do not qualify."""
    return members.where((F.col(dual_months) == 0) & (F.col(age) < age_limit))


def with_county(members: DataFrame, county: DataFrame, crosswalk: DataFrame, keys: Sequence[str] = MEMBER_KEYS) -> DataFrame:
    """Attach the county; members without one are left out. Builds the 5-character key."""
    located = members.join(county.where(F.col("county_code").isNotNull()), list(keys), "inner")
    return located.join(crosswalk, "state", "left").withColumn(
        "fips_code", county_key("fips_state", "county_code")
    )


def study_sample(
    demo: DataFrame,
    months: DataFrame,
    county: DataFrame,
    crosswalk: DataFrame,
    excluded_states: Sequence[str] = codes.EXCLUDED_STATES,
    age_limit: int = 65,
) -> DataFrame:
    """The cohort, one row per member.

    demo: beneID, state, age, disabled; months: beneID, state, medicareMonths,
    medicaidMonths; county: beneID, state, county_code.
    """
    members = single_state_members(demo).where(all_present(MEMBER_KEYS))
    members = one_row_per(members.select(*MEMBER_KEYS, "age", "disabled"), MEMBER_KEYS)
    members = without_states(members, excluded_states)
    members = eligible(members.join(months, list(MEMBER_KEYS), "inner"), age_limit)
    return with_county(members, county, crosswalk)


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]], group: str, weight: str | None = None) -> DataFrame:
    """Rows and distinct groups left after each exclusion step, in one pass.

    Every row is tagged with the number of steps it passes, the tags are
    counted per group, and the small count table is unfolded into steps.
    ``weight`` counts a row as that many (for input aggregated beforehand).
    """
    passed = F.lit(len(steps))
    for position in reversed(range(len(steps))):
        passed = F.when(F.coalesce(steps[position][1], F.lit(False)), passed).otherwise(position)
    size = F.sum(weight) if weight else F.count(F.lit(1))
    tagged = df.groupBy(passed.alias("_passed"), F.col(group)).agg(size.alias("_rows"))
    labels = F.array(*[F.lit(label) for label in ("all", *[name for name, _ in steps])])
    return (
        tagged.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_passed"))))
        .groupBy("step")
        .agg(F.sum("_rows").alias("rows"), F.countDistinct(group).alias("groups"))
        .select("step", F.get(labels, F.col("step")).alias("name"), "rows", "groups")
    )


def minimum_population(counties: DataFrame, minimum: int = codes.MINIMUM_MEMBERS, members: str = "total_members") -> DataFrame:
    return counties.where(F.col(members) >= minimum)


def screen(df: DataFrame, kept: DataFrame, unit: str | Sequence[str] = "fips_code") -> DataFrame:
    """Rows of the kept units."""
    return restrict(df, kept, names(unit))


def screening_report(counties: DataFrame, minimum: int = codes.MINIMUM_MEMBERS, members: str = "total_members") -> DataFrame:
    """Share of units that pass and members lost with the others, in one row."""
    passes = F.col(members) >= minimum
    return counties.agg(
        F.count(F.lit(1)).alias("units"),
        F.count_if(passes).alias("units_kept"),
        (F.avg(F.when(passes, 1.0).otherwise(0.0)) * 100).alias("percent_kept"),
        F.coalesce(F.sum(F.when(~passes, F.col(members))), F.lit(0)).alias("members_lost"),
    )


def scoped_claims(
    claims: DataFrame,
    sample: DataFrame,
    states: Sequence[str],
    keys: Sequence[str] = MEMBER_KEYS,
    state: str = "state",
    false_positives: float | None = None,
) -> DataFrame:
    """Claims of sample members in the listed states. The state filter reaches both scans.

    With ``false_positives`` other members' claims go at the scan, all but about
    that share of them, by a filter built from the sample; the rows returned are
    the same. For samples that are small beside the claims; store them first.
    """
    scoped = claims.where(F.col(state).isin(*states))
    if false_positives is None:
        return restrict(scoped, sample, keys)
    return restrict_early(scoped, sample, keys, rate=false_positives)
