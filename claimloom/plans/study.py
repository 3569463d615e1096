"""The whole study on the claims warehouse layout, stage by stage.

Each function takes the tables of the stages before it and returns a lazy
DataFrame. ``run`` writes them in order, so a later stage starts from files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.columns import census_region
from ..operators import (
    adjust, audit, claims, classify, cohort, cost, geography, panel, rates, relational, variation,
)
from ..sources import readers, writers
from . import acute

KEYS = ("beneID", "state")

# The columns read from the source tables.
INPATIENT_LINE = (
    "BENE_ID", "STATE_CD", "CLM_ID", "LINE_NUM", "REV_CNTR_CD", "SRVC_PRVDR_NPI",
    "SRVC_PRVDR_SPCLTY_CD", "LINE_MDCD_PD_AMT", "LINE_MDCD_FFS_EQUIV_AMT",
)
INPATIENT_HEADER = (
    "BENE_ID", "STATE_CD", "CLM_ID", "CLM_TYPE_CD", "BILL_TYPE_CD", "SRVC_BGN_DT", "SRVC_END_DT",
    "PRCDR_CD_1", "DGNS_CD_1", "DGNS_CD_2", "DGNS_CD_3", "DRG_CD", "BLG_PRVDR_NPI",
    "BLG_PRVDR_SPCLTY_CD", "BILLED_AMT", "MDCR_PD_AMT", "MDCD_PD_AMT", "MDCD_COPAY_AMT",
)
OTHER_LINE = (
    "BENE_ID", "STATE_CD", "CLM_ID", "LINE_NUM", "REV_CNTR_CD", "LINE_PRCDR_CD",
    "LINE_PRCDR_MDFR_CD_1", "SRVC_PRVDR_NPI", "SRVC_PRVDR_SPCLTY_CD", "LINE_BILLED_AMT",
    "LINE_MDCD_PD_AMT", "LINE_MDCR_PD_AMT", "LINE_COPAY_AMT", "LINE_MDCD_FFS_EQUIV_AMT",
)
OTHER_HEADER = (
    "BENE_ID", "STATE_CD", "CLM_ID", "CLM_TYPE_CD", "BILL_TYPE_CD", "SRVC_BGN_DT", "SRVC_END_DT",
    "DGNS_CD_1", "DGNS_CD_2", "POS_CD", "BLG_PRVDR_NPI", "BLG_PRVDR_SPCLTY_CD",
)
SAMPLE_COLUMNS = (
    "age", "disabled", "medicareMonths", "medicaidMonths", "county_code", "fips_state", "fips_code",
)
CLAIM_RENAMES = {"BENE_ID": "beneID", "STATE_CD": "state"}
RATE_MEASURES = ("non_emergent_acute", "acute_percent", "avoid_ed", "ed_percent", "avoid_ip", "ip_percent")


# --- analytic files -----------------------------------------------------------

def demographic_file(raw: DataFrame) -> DataFrame:
    """One row per member and state with recoded attributes."""
    return panel.member_demographics(panel.demographics(raw))


def enrolment_file(raw: DataFrame) -> DataFrame:
    """Covered member-months with enrolment, dual, plan and coverage labels."""
    months = panel.monthly_panel(raw, {"BENE_ID": "beneID", "STATE_CD": "state"})
    return panel.covered_months(panel.enrolment_labels(months))


def member_month_file(enrolment: DataFrame, demo: DataFrame) -> DataFrame:
    return panel.attach_demographics(enrolment, demo, KEYS)


def claim_file(lines: DataFrame, headers: DataFrame, month: str | None = "month") -> DataFrame:
    """Claim lines with headers over all months; the month is kept as a column."""
    return claims.assemble_claims(lines, headers, month=month)


def inpatient_completeness(inpatient: DataFrame) -> DataFrame:
    """Complete claims per state, with the overall row."""
    return claims.completeness(
        inpatient, claims.INPATIENT_FIELDS, claims.inpatient_checks(), by=["STATE_CD"], with_total=True
    )


def inpatient_payment_completeness(inpatient: DataFrame) -> DataFrame:
    return claims.completeness(
        inpatient, claims.INPATIENT_PAYMENTS, any_of=claims.INPATIENT_ANY_PAYMENT
    )


def other_completeness(other: DataFrame) -> DataFrame:
    return claims.completeness(
        other, claims.OTHER_FIELDS, claims.other_checks(), by=["STATE_CD"], with_total=True
    )


def other_payment_completeness(other: DataFrame) -> DataFrame:
    return claims.completeness(other, claims.OTHER_PAYMENTS, any_of=claims.OTHER_ANY_PAYMENT)


# --- cohort -------------------------------------------------------------------

def sample_file(demo: DataFrame, enrolment: DataFrame, county: DataFrame, excluded: Sequence[str] = codes.EXCLUDED_STATES) -> DataFrame:
    """The study cohort. ``county``: BENE_ID, STATE_CD, county_code."""
    located = county.select(
        F.col("BENE_ID").alias("beneID"), F.col("STATE_CD").alias("state"), "county_code"
    )
    crosswalk = readers.state_to_fips(demo.sparkSession)
    return cohort.study_sample(demo, panel.member_months(enrolment), located, crosswalk, excluded)


def sample_funnel(demo: DataFrame, enrolment: DataFrame, excluded: Sequence[str] = codes.EXCLUDED_STATES) -> DataFrame:
    """Records and states left after each exclusion that leads to the cohort."""
    people = demo.groupBy("beneID").agg(
        F.min("state").alias("state"), F.max("age").alias("age"), F.count(F.lit(1)).alias("records")
    )
    covered = panel.member_months(enrolment).select("beneID", "medicareMonths").groupBy("beneID").agg(
        F.max("medicareMonths").alias("medicareMonths")
    )
    steps = (
        ("one state", F.col("records") == 1),
        ("state known", F.col("state").isNotNull()),
        ("state kept", ~F.col("state").isin(*excluded)),
        ("never dual", F.col("medicareMonths") == 0),
        ("under 65", F.col("age") < 65),
    )
    return cohort.funnel(people.join(covered, "beneID", "left"), steps, "state", weight="records")


def cohort_claims(claim_lines: DataFrame, sample: DataFrame) -> DataFrame:
    """Claim lines of cohort members with the cohort columns."""
    renamed = claim_lines.withColumnsRenamed(CLAIM_RENAMES)
    return relational.restrict(renamed, sample, KEYS, SAMPLE_COLUMNS)


# --- episodes -----------------------------------------------------------------

def visit_file(inpatient: DataFrame, other: DataFrame, ed_scores: DataFrame, ip_list: DataFrame) -> DataFrame:
    """Classified event lines of the cohort's claims."""
    events = acute.acute_events(inpatient, other)
    scored = classify.score_avoidable(ed_scores).withColumnRenamed("dx", "DGNS_CD_1")
    listed = ip_list.select(F.col("diagnosisOne").alias("DGNS_CD_1"))
    return acute.classified_visits(events, scored, listed)


def episode_file(visits: DataFrame, sample: DataFrame, how: acute.EpisodeRule = acute.EpisodeRule()) -> DataFrame:
    """One classified row per episode, with its member's county."""
    return acute.acute_episodes(visits, sample, ["fips_code"], how=how)


def diagnosis_categories(visits: DataFrame, categories: DataFrame) -> DataFrame:
    """Avoidable episodes per diagnosis category."""
    marked = classify.lead_diagnosis(visits, "DGNS_CD_1")
    found = acute.acute_episodes(marked, maxima=(*classify.VISIT_FLAGS, "_ip_dx", "_ed_dx"))
    renamed = categories.withColumnRenamed("diagnosisOne", "DGNS_CD_1")
    return classify.top_categories(found, renamed, "DGNS_CD_1", "ccsrCatOne")


def county_file(sample: DataFrame, episodes: DataFrame) -> DataFrame:
    return geography.roll_up(sample, episodes)


# --- utilisation --------------------------------------------------------------

def descriptive_table(sample: DataFrame, demo: DataFrame, legacy_regions: bool = False) -> DataFrame:
    """Counts and percents of member characteristics."""
    known = demo.drop("county", "disabled", "age")
    people = panel.attach_demographics(sample, known, KEYS).withColumn(
        "censusRegion", census_region("state", legacy_regions)
    )
    return rates.describe_categories(people, codes.DESCRIPTIVE_COLUMNS)


def named_counties(counties: DataFrame) -> DataFrame:
    return geography.with_state_name(counties, readers.fips_to_state(counties.sparkSession))


def overall_rates(counties: DataFrame) -> DataFrame:
    return rates.utilisation(counties)


def state_rates(counties: DataFrame) -> DataFrame:
    return rates.utilisation(named_counties(counties), "state_name")


def county_rates(counties: DataFrame) -> DataFrame:
    return rates.utilisation(named_counties(counties), ["state_name", "fips_code"])


def counties_within_state(county_rate: DataFrame, kind: str) -> DataFrame:
    return variation.spread(county_rate, "state_name", variation.CARE_MEASURES[kind])


def published_counties(counties: DataFrame, limit: int = codes.SMALL_CELL) -> DataFrame:
    return geography.suppress(named_counties(counties), limit=limit)


# --- cost ---------------------------------------------------------------------

# Cost study -> states, PMPY column, needed claim files.
COST_STUDIES = {
    "total": (codes.TOTAL_COST_STATES, "avoid_acute_cost"),
    "ed": (codes.ED_COST_STATES, "avoid_ed_cost"),
    "ip": (codes.INPATIENT_COST_STATES, "avoid_ip_cost"),
}
UNITS = {"state": ["state"], "county": ["fips_code", "state"], "member": ["beneID", "state"]}


ALL_COST_STATES = tuple(sorted({state for states, _ in COST_STUDIES.values() for state in states}))
MEMBER_GRAIN = ["beneID", "state", "fips_code"]


def inpatient_spend(inpatient: DataFrame, sample: DataFrame, states: Sequence[str] = ALL_COST_STATES) -> DataFrame:
    """Inpatient cost per cohort member: the one pass over these claims that all cost studies share."""
    return cost.inpatient_cost(cohort.scoped_claims(inpatient, sample, states), MEMBER_GRAIN)


def service_spend(other: DataFrame, sample: DataFrame, states: Sequence[str] = ALL_COST_STATES) -> DataFrame:
    """Total and emergency cost of services per cohort member, in one pass likewise."""
    return cost.service_costs(cohort.scoped_claims(other, sample, states), MEMBER_GRAIN)


def _of_study(study: str, spend: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Members of a study's states that have any of the columns, with these."""
    some = reduce(or_, [F.col(c).isNotNull() for c in columns])
    return spend.where(F.col("state").isin(*COST_STUDIES[study][0]) & some).select(*MEMBER_GRAIN, *columns)


INPATIENT_AMOUNTS = ("ffs_amount_ip", "mc_amount_ip", "inpatient_cost")
ED_AMOUNTS = ("ffs_amount_ed", "mc_amount_ed", "total_cost_ed")
OTHER_AMOUNTS = ("ffs_amount_other", "mc_amount_other", "total_cost_other")


def cost_table(study: str, unit: str, stays: DataFrame | None = None, services: DataFrame | None = None) -> DataFrame:
    """Cost columns of a study per unit, from the members' spend."""
    keys = UNITS[unit]
    if study == "ed":
        return cost.sum_spend(_of_study(study, services, ED_AMOUNTS), keys)
    inpatient = cost.sum_spend(_of_study(study, stays, INPATIENT_AMOUNTS), keys)
    if study == "ip":
        return inpatient
    return cost.combine_costs(inpatient, [cost.sum_spend(_of_study(study, services, OTHER_AMOUNTS + ED_AMOUNTS), keys)], keys)


def unit_cost_table(study: str, unit: str, rate: DataFrame, stays: DataFrame | None = None, services: DataFrame | None = None) -> DataFrame:
    """Cost, avoidable cost and PMPY per state or county; ``rate`` holds that unit's rates."""
    percents = rate.withColumnRenamed("state_name", "state").select(
        *UNITS[unit], "member_month", "ip_percent", "ed_percent"
    )
    table = cost_table(study, unit, stays, services)
    return cost.unit_costs(table, percents, UNITS[unit], {"pmpy": COST_STUDIES[study][1]})


def member_cost_table(study: str, sample: DataFrame, county_rate: DataFrame, stays: DataFrame | None = None, services: DataFrame | None = None) -> DataFrame:
    """Cost rows of every cohort member in the study's states, non-users included."""
    states, pmpy = COST_STUDIES[study]
    people = sample.where(F.col("state").isin(*states)).select(*KEYS, "fips_code")
    parts = []
    if study in ("total", "ip"):
        parts.append((_of_study(study, stays, INPATIENT_AMOUNTS), ["inpatient_cost"]))
    if study == "total":
        parts.append((_of_study(study, services, OTHER_AMOUNTS + ED_AMOUNTS), ["total_cost_ed", "total_cost_other"]))
    if study == "ed":
        parts.append((_of_study(study, services, ED_AMOUNTS), ["total_cost_ed"]))
    percents = county_rate.select("fips_code", "member_month", "ip_percent", "ed_percent")
    return cost.member_costs(people, parts, percents, {"pmpy": pmpy})


def savings_table(county_costs: DataFrame) -> DataFrame:
    both = cost.with_pmpy(county_costs, {"pmpy_ed": "avoid_ed_cost", "pmpy_ip": "avoid_ip_cost"})
    return cost.savings_to_median(
        both.select("fips_code", "state", "member_month", "pmpy_ed", "pmpy_ip")
    )


def age_adjusted_rates(state_rate: DataFrame, sample: DataFrame, demo: DataFrame) -> DataFrame:
    """Avoidable visit rate per state predicted from its age mix."""
    people = panel.attach_demographics(sample, demo.select(*KEYS, "ageCat"), KEYS)
    visits = state_rate.select(
        F.col("state_name").alias("state"), F.col("non_emergent_acute").alias("avoid_acute")
    )
    return adjust.adjusted(visits, adjust.composition(people), "avoid_acute")


# --- orchestration ------------------------------------------------------------

@dataclass(frozen=True)
class Sources:
    """Where the source tables are. Templates take the two-digit month."""

    eligibility: str
    inpatient_line: str
    inpatient_header: str
    other_line: str
    other_header: str
    member_county: str
    ed_scores: str
    ip_list: str
    months: Sequence[str] = readers.MONTHS


@dataclass(frozen=True)
class Target:
    """Where results go: a database and, for releases, a shared folder for CSV files."""

    database: str
    release_folder: str | None = None
    location: str | None = None
    minimum_members: int = codes.MINIMUM_MEMBERS
    small_cell: int = codes.SMALL_CELL
    excluded_states: Sequence[str] = codes.EXCLUDED_STATES
    partition_claims_by: Sequence[str] = field(default=("state",))

    def save(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
        path = f"{self.location.rstrip('/')}/{name}" if self.location else None
        return writers.save_table(df, f"{self.database}.{name}", partition_by, path)

    def publish(self, df: DataFrame, name: str) -> None:
        if self.release_folder:
            writers.save_csv(df, f"{self.release_folder.rstrip('/')}/{name}")


def run(spark: SparkSession, sources: Sources, target: Target) -> Mapping[str, DataFrame]:
    """Run every stage and return the tables it wrote, as scans."""
    out: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        out[name] = target.save(df, name, partition_by)
        return out[name]

    def family(template: str, columns: Sequence[str], condition=None) -> DataFrame:
        return readers.read_month_family(
            spark, template, columns, ["BENE_ID", "STATE_CD"], condition, sources.months
        )

    raw = spark.table(sources.eligibility)
    demo = keep("demographics", demographic_file(raw))
    keep("demographics_missing", audit.missingness(demo))
    keep("demographics_coverage", audit.coverage(demo))
    enrolment = keep("enrolment", enrolment_file(raw))
    keep("member_months", member_month_file(enrolment, demo))
    sample = keep(
        "sample",
        sample_file(demo, enrolment, spark.table(sources.member_county), target.excluded_states),
    )
    keep("sample_funnel", sample_funnel(demo, enrolment, target.excluded_states))

    wanted = F.col("CLM_TYPE_CD").isin(*codes.CLAIM_TYPES)
    stays = keep(
        "inpatient_claims",
        claim_file(
            family(sources.inpatient_line, INPATIENT_LINE),
            family(sources.inpatient_header, INPATIENT_HEADER, wanted),
        ),
    )
    services = keep(
        "other_claims",
        claim_file(
            family(sources.other_line, OTHER_LINE),
            family(sources.other_header, OTHER_HEADER, wanted),
        ),
    )
    keep("inpatient_completeness", inpatient_completeness(stays))
    keep("inpatient_payments", inpatient_payment_completeness(stays))
    keep("other_completeness", other_completeness(services))
    keep("other_payments", other_payment_completeness(services))
    inpatient = keep("inpatient_cohort", cohort_claims(stays, sample), target.partition_claims_by)
    other = keep("other_cohort", cohort_claims(services, sample), target.partition_claims_by)

    ed_scores = readers.read_lookup(spark, sources.ed_scores, readers.ED_SCORE_SCHEMA)
    ip_list = readers.read_lookup(spark, sources.ip_list, readers.IP_LIST_SCHEMA)
    visits = keep("visits", visit_file(inpatient, other, ed_scores, ip_list))
    every_episode = keep("episodes_all", episode_file(visits, sample))
    every_county = keep("counties_all", county_file(sample, every_episode))

    keep("screening", cohort.screening_report(every_county, target.minimum_members))
    counties = keep("counties", cohort.minimum_population(every_county, target.minimum_members))
    members = keep("sample_screened", cohort.screen(sample, counties))
    episodes = keep("episodes", cohort.screen(every_episode, counties))

    keep("descriptive", descriptive_table(members, demo))
    keep("rates_overall", overall_rates(counties))
    state_rate = keep("rates_state", state_rates(counties))
    county_rate = keep("rates_county", county_rates(counties))
    keep("county_sizes", variation.size_summary(counties, "total_members"))
    for unit, table in (("states", state_rate), ("counties", county_rate)):
        keep(f"rates_distribution_{unit}", variation.distribution(table, RATE_MEASURES))
    counts = keep("member_counts", rates.member_counts(episodes, members))
    for kind, measures in variation.CARE_MEASURES.items():
        within_state = keep(f"within_state_{kind}", counties_within_state(county_rate, kind))
        within_county = keep(f"within_county_{kind}", variation.spread(counts, "fips_code", measures))
        keep(f"ranges_within_state_{kind}", variation.distribution(within_state, ["range_rate", "range_percent"]))
        keep(f"ranges_within_county_{kind}", variation.distribution(within_county, ["range_rate", "iqr_percent"]))
    target.publish(
        geography.release(county_rate, geography.UTILISATION_COLUMNS, geography.UTILISATION_RENAMES),
        "utilisation_county",
    )
    target.publish(published_counties(counties, target.small_cell), "counties_suppressed")
    target.publish(counties.select("fips_code", "total_members", "member_month"), "member_months")

    releases = {
        "total": (geography.TOTAL_SPEND_COLUMNS, geography.TOTAL_SPEND_RENAMES),
        "ed": (geography.ED_SPEND_COLUMNS, geography.ED_SPEND_RENAMES),
        "ip": (geography.IP_SPEND_COLUMNS, geography.IP_SPEND_RENAMES),
    }
    files = {
        "stays": keep("spend_inpatient", inpatient_spend(inpatient, members)),
        "services": keep("spend_services", service_spend(other, members)),
    }
    for study, (columns, renames) in releases.items():
        by_state = keep(f"cost_{study}_state", unit_cost_table(study, "state", state_rate, **files))
        by_county = keep(f"cost_{study}_county", unit_cost_table(study, "county", county_rate, **files))
        by_member = keep(f"cost_{study}_member", member_cost_table(study, members, county_rate, **files))
        keep(f"cost_{study}_total", cost.pmpy_total(by_state, COST_STUDIES[study][1]))
        ranges = {
            "state": keep(f"cost_{study}_within_state", variation.spread(by_county, "state", {"rate": "pmpy"})),
            "county": keep(f"cost_{study}_within_county", variation.spread(by_member, "fips_code", {"rate": "pmpy"})),
        }
        for unit, table in (("states", by_state), ("counties", by_county), ("members", by_member)):
            keep(f"cost_{study}_distribution_{unit}", variation.distribution(table, ["pmpy"]))
        for unit, table in ranges.items():
            keep(f"cost_{study}_ranges_within_{unit}", variation.distribution(table, ["range_rate"]))
        target.publish(geography.release(by_county, columns, renames), f"spend_{study}")

    savings = keep("savings_county", savings_table(out["cost_total_county"]))
    keep("savings_state", cost.savings_summary(savings, "state", with_total=True))
    keep("age_adjusted", age_adjusted_rates(state_rate, members, demo))
    return out
