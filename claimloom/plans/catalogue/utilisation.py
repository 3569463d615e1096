"""County roll-up, rates, variation, suppression and adjustment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import codes
from ...functions.columns import bands
from ...operators import adjust, classify, cohort, geography, rates, variation
from .. import acute, testbed
from ..testbed import per_session, with_views
from .episodes import classified
from .panel import AGE_CASE, BANDS, COMPOSITION, age_mix
from .registry import query

MINIMUM = 8  # members per county; the data has 125 counties of about 12 members
ACCURACY = 1_000_000
UNIT = ["fips_code", "state"]


@per_session
def county_file(spark, folder):
    found = classified(spark, folder, classify.VISIT_FLAGS)
    return acute.county_file(testbed.members(spark, folder), found, UNIT)


def rates_view(name: str, by: str = "") -> str:
    """Named subquery with the rates and shares of a grouping."""
    keys = f"{by}, " if by else ""
    group = f" group by {by}" if by else ""
    measures = {
        "avoid_ip": "avoid_ip", "total_ip": "total_ip", "avoid_ed": "avoid_ed", "total_ed": "total_ed",
        "non_emergent_acute": "non_emergent_acute", "all_cause_acute": "total_acute",
    }
    sums = ", ".join(f"cast(sum({m}) as double) as {n}" for m, n in measures.items())
    scaled = ", ".join(f"round({n} / nullif(months, 0) * 1000, 1) as {n}" for n in measures.values())
    return f"""{name} as (
  select *, round(avoid_ip / nullif(total_ip, 0) * 100, 1) as ip_percent,
         round(avoid_ed / nullif(total_ed, 0) * 100, 1) as ed_percent,
         round(non_emergent_acute / nullif(total_acute, 0) * 100, 1) as acute_percent
  from (select {keys}cast(months as bigint) as member_month, {scaled}
        from (select {keys}cast(sum(member_month) as double) as months, {sums} from v_county{group})))"""


STATE_RATES = rates_view("v_state_rates", "state")
COUNTY_RATES = rates_view("v_county_rates", "fips_code, state")


@query(
    "county_rollup",
    with_views(
        """select fips_code, state, total_members, member_month, non_avoid_ip, avoid_ip, non_avoid_ed, avoid_ed,
                  non_emergent_acute, emergent_acute, all_cause_acute, total_ip, total_ed from v_county"""
    ),
)
def county_rollup(spark, folder):
    return county_file(spark, folder)


SIZES = """v_sizes as (select fips_code, count(*) as total_members, cast(sum(member_months) as bigint) as member_month
                       from v_member group by fips_code)"""


def sizes(spark, folder):
    return geography.unit_members(testbed.members(spark, folder), "fips_code")


def _quantile(column: str, point: float) -> str:
    if point == 0:
        return f"min({column})"
    if point == 1:
        return f"max({column})"
    return f"quantile_disc({column}, {point})"


@query(
    "unit_sizes",
    with_views(
        " union all ".join(
            f"select 'total_members' as measure, {p}::double as point, cast({_quantile('total_members', p)} as double) as value from v_sizes"
            for p in codes.SIZE_POINTS
        ),
        SIZES,
    ),
)
def unit_sizes(spark, folder):
    return variation.distribution(sizes(spark, folder), ["total_members"], codes.SIZE_POINTS, ACCURACY)


@query(
    "min_population",
    with_views(
        f"""select member_id, state, v_member.fips_code from v_member
            where fips_code in (select fips_code from v_sizes where total_members >= {MINIMUM})""",
        SIZES,
    ),
)
def min_population(spark, folder):
    kept = cohort.minimum_population(sizes(spark, folder), MINIMUM)
    people = testbed.members(spark, folder).select(F.col("beneID").alias("member_id"), "state", "fips_code")
    return cohort.screen(people, kept)


@query(
    "min_population_episodes",
    with_views(
        f"""select member_id, episode, v_class.fips_code, non_avoid_ip, avoid_ip, non_avoid_ed, avoid_ed from v_class
            where fips_code in (select fips_code from v_sizes where total_members >= {MINIMUM})""",
        SIZES,
    ),
)
def min_population_episodes(spark, folder):
    kept = cohort.minimum_population(sizes(spark, folder), MINIMUM)
    found = classified(spark, folder, classify.VISIT_FLAGS)
    return cohort.screen(found, kept).select(
        F.col("beneID").alias("member_id"), "episode", "fips_code", *classify.CLASSES
    )


@query(
    "screening_report",
    with_views(
        f"""select count(*) as units, count(*) filter (total_members >= {MINIMUM}) as units_kept,
                   count(*) filter (total_members >= {MINIMUM}) * 100.0::double / count(*) as percent_kept,
                   cast(coalesce(sum(total_members) filter (total_members < {MINIMUM}), 0) as bigint) as members_lost
            from v_sizes""",
        SIZES,
    ),
)
def screening_report(spark, folder):
    out = cohort.screening_report(sizes(spark, folder), MINIMUM)
    return out.withColumn("percent_kept", F.col("units_kept") * F.lit(100.0) / F.col("units"))


@query(
    "share_meeting",
    """select count(*) as rows, round(count(*) filter (o_totalprice > 100000) * 100.0::double / count(*), 6) as percent from orders""",
)
def share_meeting(spark, folder):
    out = rates.percent_meeting(testbed.table(spark, folder, "orders"), F.col("o_totalprice") > 100000)
    return out.withColumn("percent", F.round("percent", 6))


@query(
    "describe_categories",
    with_views(
        """select variable, level, count(*) as "Count", round(count(*)::double / (select count(*) from v_member) * 100, 1) as "Percentage"
           from (select 'ageCat' as variable, band as level from v_banded union all
                 select 'region', region from v_banded union all select 'member_months', cast(member_months as varchar) from v_banded)
           group by variable, level""",
        f"v_banded as (select {AGE_CASE} as band, region, member_months from v_member)",
    ),
)
def describe_categories(spark, folder):
    people = testbed.members(spark, folder).withColumn("ageCat", bands("age")).withColumnRenamed(
        "medicaidMonths", "member_months"
    )
    return rates.describe_categories(people, ["ageCat", "region", "member_months"])


@query("rate_total", with_views("select * from v_total_rates", rates_view("v_total_rates")))
def rate_total(spark, folder):
    return acute.utilisation_by(county_file(spark, folder))


@query("rate_state", with_views("select * from v_state_rates", STATE_RATES))
def rate_state(spark, folder):
    return acute.utilisation_by(county_file(spark, folder), "state")


@query("rate_county", with_views("select * from v_county_rates", COUNTY_RATES))
def rate_county(spark, folder):
    return acute.utilisation_by(county_file(spark, folder), UNIT)


@query(
    "avoidable_share",
    with_views(
        """select fips_code, state, round(cast(avoid_ip as double) / nullif(total_ip, 0) * 100, 1) as ip_percent,
                  round(cast(avoid_ed as double) / nullif(total_ed, 0) * 100, 1) as ed_percent,
                  round(cast(non_emergent_acute as double) / nullif(all_cause_acute, 0) * 100, 1) as acute_percent
           from v_county"""
    ),
)
def avoidable_share(spark, folder):
    totals = rates.unit_totals(county_file(spark, folder), UNIT)
    return rates.avoidable_shares(totals).select(*UNIT, *rates.SHARES)


MEMBER_COUNTS = """v_member_counts as (
  select *, coalesce(round(avoid_ip / nullif(total_ip, 0)::double * 100, 1), 0.0::double) as ip_percent,
         coalesce(round(avoid_ed / nullif(total_ed, 0)::double * 100, 1), 0.0::double) as ed_percent,
         coalesce(round(non_emergent_acute / nullif(all_cause_acute, 0)::double * 100, 1), 0.0::double) as acute_percent
  from (select v_class.member_id, v_class.state, v_class.fips_code, any_value(cast(v_member.member_months as bigint)) as member_month,
               cast(sum(avoid_ip) as bigint) as avoid_ip, cast(sum(avoid_ed) as bigint) as avoid_ed,
               cast(sum(avoid_ip + avoid_ed) as bigint) as non_emergent_acute,
               cast(sum(avoid_ip + avoid_ed + non_avoid_ip + non_avoid_ed) as bigint) as all_cause_acute,
               cast(sum(avoid_ip + non_avoid_ip) as bigint) as total_ip, cast(sum(avoid_ed + non_avoid_ed) as bigint) as total_ed
        from v_class join v_member on v_class.member_id = v_member.member_id
        group by v_class.member_id, v_class.state, v_class.fips_code))"""


def per_member(spark, folder):
    found = classified(spark, folder, classify.VISIT_FLAGS)
    return rates.member_counts(found, testbed.members(spark, folder))


@query("member_counts", with_views("select * from v_member_counts", MEMBER_COUNTS))
def member_counts(spark, folder):
    return per_member(spark, folder).withColumnRenamed("beneID", "member_id")


CELL = 3  # smallest count that may be released, scaled to the data like MINIMUM


@query(
    "small_cell",
    with_views(
        "select fips_code, state, total_members, "
        + ", ".join(codes.SUPPRESSED_MEASURES)
        + " from v_county where "
        + " and ".join(f"{m} > {CELL}" for m in codes.SUPPRESSED_MEASURES)
    ),
)
def small_cell(spark, folder):
    return geography.suppress(county_file(spark, folder), limit=CELL).select(
        *UNIT, "total_members", *codes.SUPPRESSED_MEASURES
    )


@query(
    "release_extract",
    with_views(
        """select state as state_name, fips_code, avoid_ed, avoid_ip, non_emergent_acute as avoid_acute,
                  ip_percent, ed_percent, acute_percent from v_county_rates""",
        COUNTY_RATES,
    ),
)
def release_extract(spark, folder):
    county = rate_county(spark, folder).withColumnRenamed("state", "state_name")
    return geography.release(county, geography.UTILISATION_COLUMNS, geography.UTILISATION_RENAMES)


DISTRIBUTED = ("non_emergent_acute", "acute_percent", "avoid_ed", "ed_percent", "avoid_ip", "ip_percent")


def _distribution_sql(view: str, columns=DISTRIBUTED, points=codes.QUARTILES) -> str:
    return " union all ".join(
        f"select '{c}' as measure, {p}::double as point, cast({_quantile(c, p)} as double) as value from {view}"
        for c in columns
        for p in points
    )


@query("distribution", with_views(_distribution_sql("v_state_rates"), STATE_RATES))
def distribution_states(spark, folder):
    return variation.distribution(rate_state(spark, folder), DISTRIBUTED, accuracy=ACCURACY)


@query("distribution_counties", with_views(_distribution_sql("v_county_rates"), COUNTY_RATES))
def distribution_counties(spark, folder):
    return variation.distribution(rate_county(spark, folder), DISTRIBUTED, accuracy=ACCURACY)


def spread_sql(view: str, by: str, measures: dict[str, str]) -> str:
    columns = ", ".join(
        f"quantile_disc({c}, 0.25) as p25_{s}, quantile_disc({c}, 0.75) as p75_{s}, min({c}) as min_{s}, max({c}) as max_{s}, "
        f"max({c}) - min({c}) as range_{s}, quantile_disc({c}, 0.75) - quantile_disc({c}, 0.25) as iqr_{s}"
        for s, c in measures.items()
    )
    return f"select {by}, {columns} from {view} group by {by}"


def _register_variation(kind: str, measures: dict[str, str]) -> None:
    @query(f"within_state_variation_{kind}", with_views(spread_sql("v_county_rates", "state", measures), COUNTY_RATES))
    def within_state(spark, folder):
        return variation.spread(rate_county(spark, folder), "state", measures, ACCURACY)

    @query(
        f"within_county_variation_{kind}",
        with_views(spread_sql("v_member_counts", "fips_code", measures), MEMBER_COUNTS),
    )
    def within_county(spark, folder):
        return variation.spread(per_member(spark, folder), "fips_code", measures)

    @query(
        f"range_distribution_{kind}",
        with_views(
            _distribution_sql("v_spread", ("range_rate", "range_percent")),
            COUNTY_RATES,
            f"v_spread as ({spread_sql('v_county_rates', 'state', measures)})",
        ),
    )
    def ranges(spark, folder):
        return variation.distribution(
            within_state(spark, folder), ["range_rate", "range_percent"], accuracy=ACCURACY
        )


    @query(
        f"range_distribution_members_{kind}",
        with_views(
            _distribution_sql("v_spread", ("range_rate", "iqr_percent")),
            MEMBER_COUNTS,
            f"v_spread as ({spread_sql('v_member_counts', 'fips_code', measures)})",
        ),
    )
    def member_ranges(spark, folder):
        return variation.distribution(
            within_county(spark, folder), ["range_rate", "iqr_percent"], accuracy=ACCURACY
        )


for _kind, _measures in variation.CARE_MEASURES.items():
    _register_variation(_kind, _measures)


@query(
    "member_month_summary",
    with_views(
        " union all ".join(
            f"select '{label}' as summary, cast({_quantile('total_members', p)} as double) as total_members from v_sizes "
            f"where total_members >= {MINIMUM}"
            for label, p in (
                ("min", 0), ("25%", 0.25), ("50%", 0.5), ("75%", 0.75), ("90%", 0.9), ("95%", 0.95),
                ("99%", 0.99), ("max", 1),
            )
        ),
        SIZES,
    ),
)
def member_month_summary(spark, folder):
    kept = cohort.minimum_population(sizes(spark, folder), MINIMUM)
    return variation.size_summary(kept, "total_members").orderBy("summary")


def _least_squares() -> list[str]:
    """Named subqueries that make the band columns orthogonal one after the other, and the fitted values."""
    n = len(BANDS)
    centred = ", ".join(f"p{i} - avg(p{i}) over () as c{i}" for i in range(n))
    steps = [
        f"v_fit0 as (select r.state, non_emergent_acute as y, {centred} from v_state_rates r join v_comp on r.state = v_comp.state)"
    ]
    for k in range(n - 1):
        rest = ", ".join(
            f"c{j} - case when sum(c{k} * c{k}) over () > 1e-9 then sum(c{j} * c{k}) over () / sum(c{k} * c{k}) over () else 0 end * c{k} as c{j}"
            for j in range(k + 1, n)
        )
        steps.append(f"v_fit{k + 1} as (select state, y, {', '.join(f'c{j}' for j in range(k + 1))}, {rest} from v_fit{k})")
    fitted = " + ".join(
        f"case when sum(c{k} * c{k}) over () > 1e-9 then sum(y * c{k}) over () / sum(c{k} * c{k}) over () else 0 end * c{k}" for k in range(n)
    )
    return [*steps, f"v_fitted as (select state, avg(y) over () + {fitted} as prediction from v_fit{n - 1})"]


@query(
    "regression_adjust",
    with_views("select state, round(prediction, 3) as prediction from v_fitted", STATE_RATES, COMPOSITION, *_least_squares()),
)
def regression_adjust(spark, folder):
    visits = rate_state(spark, folder).select("state", F.col("non_emergent_acute").alias("avoid_acute"))
    fitted = adjust.adjusted(visits, age_mix(spark, folder), "avoid_acute", tolerance=1e-12)
    return fitted.withColumn("prediction", F.round("prediction", 3))


@query(
    "adjustment_inputs",
    with_views(
        "select r.state, non_emergent_acute as avoid_acute, "
        + ", ".join(f'p{i} as "sum_{b}_percentage"' for i, b in enumerate(BANDS))
        + " from v_state_rates r left join v_comp on r.state = v_comp.state",
        STATE_RATES, COMPOSITION,
    ),
)
def adjustment_inputs(spark, folder):
    visits = rate_state(spark, folder).select("state", F.col("non_emergent_acute").alias("avoid_acute"))
    return visits.join(age_mix(spark, folder).drop("total", "total_percentage"), "state", "left")
