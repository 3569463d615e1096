"""Cost, avoidable cost, cost per member per year and savings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import codes
from ...functions.columns import any_match
from ...operators import cohort, cost, geography, relational, selection, variation
from ...sources import writers
from .. import testbed
from ..testbed import per_session, with_views
from .episodes import claims
from .registry import query
from .utilisation import (
    ACCURACY, COUNTY_RATES, MINIMUM, SIZES, STATE_RATES, _distribution_sql, _quantile, rate_county, rate_state,
    sizes, spread_sql,
)

UNITS = {
    "state": ["state"],
    "county": ["fips_code", "state"],
    "member": ["beneID", "state", "fips_code"],
}
SQL_UNITS = {"state": "state", "county": "fips_code, state", "member": "member_id, state, fips_code"}
AMOUNTS = {"line_paid": "line_paid", "line_equivalent": "line_equiv"}


@per_session
def cost_lines(spark, folder, parts=True):
    """Claim lines with the member's state and county."""
    people = testbed.members(spark, folder).select("beneID", "state", "fips_code")
    return relational.restrict(claims(spark, folder, parts), people, "beneID", ["state", "fips_code"])


def inpatient(spark, folder, unit):
    stays = cost_lines(spark, folder, False).where(F.col("file_code") == "F")
    return cost.inpatient_cost(stays, UNITS[unit], line_equivalent="line_equiv")


def other(spark, folder, unit):
    services = cost_lines(spark, folder, False).where(F.col("file_code") == "O")
    return cost.line_cost(services, UNITS[unit], **AMOUNTS)


def emergency(spark, folder, unit):
    services = cost_lines(spark, folder).where(F.col("file_code") == "O")
    return cost.ed_cost(services, UNITS[unit], any_match(testbed.ED_SIGNALS), **AMOUNTS)


def services(spark, folder, unit):
    """Other and emergency cost together, as the total-cost study needs both."""
    lines = cost_lines(spark, folder).where(F.col("file_code") == "O")
    return cost.service_costs(lines, UNITS[unit], any_match(testbed.ED_SIGNALS), **AMOUNTS)


def doubles(df):
    """Decimal amounts as doubles, the type the check compares."""
    wanted = {c: F.col(c).cast("double") for c, t in df.dtypes if t.startswith("decimal")}
    out = df.withColumns(wanted) if wanted else df
    return out.withColumnRenamed("beneID", "member_id")


LINES = """v_cost_line as (
  select c.*, m.state, m.fips_code from v_claim c join v_member m on c.member_id = m.member_id)"""


def ip_view(unit: str) -> str:
    """Inpatient cost in exact millionths: the mean of an encounter's lines is rounded half up."""
    return f"""v_ip_{unit} as (
  select {SQL_UNITS[unit]}, cast(sum(ffs) as double) / 1000000 as ffs_amount_ip, cast(sum(mc) as double) / 1000000 as mc_amount_ip,
         cast(sum(ffs) + sum(mc) as double) / 1000000 as inpatient_cost
  from (select state, fips_code, member_id, claim_id,
               case when max(claim_type) = '1' then cast(max(header_paid) * 100 as hugeint) * 10000 else 0 end as ffs,
               case when max(claim_type) = '3' then
                 (cast(sum(line_equiv) * 100 as hugeint) * 20000 + count(*)) // (2 * count(*)) else 0 end as mc
        from v_cost_line where file_code = 'F' group by state, fips_code, member_id, claim_id)
  group by {SQL_UNITS[unit]})"""


def line_view(name: str, suffix: str, unit: str, extra: str = "") -> str:
    ffs = "coalesce(sum(line_paid) filter (claim_type = '1'), 0)"
    mc = "coalesce(sum(line_equiv) filter (claim_type = '3'), 0)"
    return f"""{name}_{unit} as (
  select {SQL_UNITS[unit]}, cast({ffs} as double) as ffs_amount_{suffix}, cast({mc} as double) as mc_amount_{suffix},
         cast({ffs} + {mc} as double) as total_cost_{suffix}
  from v_cost_line where file_code = 'O'{extra} group by {SQL_UNITS[unit]})"""


ED_TEST = " and (rev_code = 'R' or place_code = '7' or proc_code in ('PROMO', 'ECONOMY'))"


def ed_view(unit: str) -> str:
    return line_view("v_ed", "ed", unit, ED_TEST)


def other_view(unit: str) -> str:
    return line_view("v_other", "other", unit)


def _register_costs(unit: str) -> None:
    @query(f"ip_claim_cost_{unit}", with_views(f"select * from v_ip_{unit}", LINES, ip_view(unit)))
    def ip_claim_cost(spark, folder):
        return doubles(inpatient(spark, folder, unit))

    @query(f"line_cost_{unit}", with_views(f"select * from v_other_{unit}", LINES, other_view(unit)))
    def line_cost(spark, folder):
        return doubles(other(spark, folder, unit))

    @query(f"ed_cost_{unit}", with_views(f"select * from v_ed_{unit}", LINES, ed_view(unit)))
    def ed_cost(spark, folder):
        return doubles(emergency(spark, folder, unit))


for _unit in UNITS:
    _register_costs(_unit)


# Nations standing for the states whose payment data is usable.
SCOPE = tuple(f"NATION_{i}" for i in range(0, 24, 3))


SCOPED = with_views(
    "select claim_id, line_num, member_id, state from v_cost_line where state in ({}) and fips_code in "
    "(select fips_code from v_sizes where total_members >= {})".format(
        ", ".join(f"'{s}'" for s in SCOPE), MINIMUM
    ),
    LINES, SIZES,
)


def scoped(spark, folder, lines, false_positives=None):
    kept = cohort.minimum_population(sizes(spark, folder), MINIMUM)
    sample = cohort.screen(testbed.members(spark, folder), kept)
    if false_positives:
        sample = writers.stored(sample.select(*cohort.MEMBER_KEYS), "sample")
    return cohort.scoped_claims(lines, sample, SCOPE, false_positives=false_positives).select(
        F.col("CLM_ID").alias("claim_id"), F.col("LINE_NUM").alias("line_num"),
        F.col("beneID").alias("member_id"), "state",
    )


@query("scoped_claims", SCOPED)
def scoped_claims(spark, folder):
    return scoped(spark, folder, cost_lines(spark, folder, False))


@query("scoped_claims_filtered", SCOPED)
def scoped_claims_filtered(spark, folder):
    """The same; other members' claims go by a filter built from the stored sample, before they move."""
    return scoped(spark, folder, cost_lines(spark, folder, False), false_positives=0.01)


COSTS = ["inpatient_cost", "total_cost_ed", "total_cost_other"]


def combined_view(unit: str) -> str:
    keys = SQL_UNITS[unit]
    return f"""v_cost_{unit} as (
  select {keys}, inpatient_cost, total_cost_ed, total_cost_other
  from v_ip_{unit} left join v_ed_{unit} using ({keys}) left join v_other_{unit} using ({keys}))"""


def combined(spark, folder, unit, stays_only=True):
    """All three costs in one pass: the test lines hold both kinds of claim."""
    found = cost.all_costs(
        cost_lines(spark, folder), UNITS[unit], F.col("file_code") == "F", any_match(testbed.ED_SIGNALS), **AMOUNTS,
        stays_only=stays_only,
    )
    return found.select(*UNITS[unit], *COSTS)


@query(
    "cost_side_by_side",
    with_views(
        "select fips_code, state, inpatient_cost, total_cost_ed, total_cost_other from v_cost_county",
        LINES, ip_view("county"), ed_view("county"), other_view("county"), combined_view("county"),
    ),
)
def cost_side_by_side(spark, folder):
    stays, others = inpatient(spark, folder, "county"), services(spark, folder, "county")
    return doubles(cost.combine_costs(stays, [others], UNITS["county"]).select(*UNITS["county"], *COSTS))


@query(
    "cost_combined",
    with_views(
        "select fips_code, state, inpatient_cost, total_cost_ed, total_cost_other from v_cost_county",
        LINES, ip_view("county"), ed_view("county"), other_view("county"), combined_view("county"),
    ),
)
def cost_combined(spark, folder):
    return doubles(combined(spark, folder, "county"))


# Cost studies: the cost tables, the avoidable parts and the one PMPY is taken from.
STUDIES = {
    "total": {"costs": COSTS, "avoid": ["avoid_ed_cost", "avoid_ip_cost", "avoid_acute_cost"], "of": "avoid_acute_cost"},
    "ed": {"costs": ["total_cost_ed"], "avoid": ["avoid_ed_cost"], "of": "avoid_ed_cost"},
    "ip": {"costs": ["inpatient_cost"], "avoid": ["avoid_ip_cost"], "of": "avoid_ip_cost"},
}
PERCENTS = ["member_month", "ip_percent", "ed_percent"]
AVOID_SQL = {
    "avoid_ed_cost": "total_cost_ed * ed_percent / 100",
    "avoid_ip_cost": "inpatient_cost * ip_percent / 100",
    "avoid_acute_cost": "total_cost_ed * ed_percent / 100 + inpatient_cost * ip_percent / 100",
}


def study_costs(spark, folder, study, unit):
    if study == "total":
        return combined(spark, folder, unit)
    build = emergency if study == "ed" else inpatient
    return build(spark, folder, unit).select(*UNITS[unit], *STUDIES[study]["costs"])


def percents(spark, folder, unit):
    table = rate_state(spark, folder) if unit == "state" else rate_county(spark, folder)
    return table.select(*UNITS["state" if unit == "state" else "county"], *PERCENTS)


def unit_costs(spark, folder, study, unit):
    return cost.unit_costs(
        study_costs(spark, folder, study, unit), percents(spark, folder, unit), UNITS[unit],
        {"pmpy": STUDIES[study]["of"]},
    )


def cost_views(study: str, unit: str) -> list[str]:
    if study == "total":
        return [LINES, ip_view(unit), ed_view(unit), other_view(unit), combined_view(unit)]
    build, name = (ed_view, "v_ed") if study == "ed" else (ip_view, "v_ip")
    column = STUDIES[study]["costs"][0]
    return [LINES, build(unit), f"v_cost_{unit} as (select {SQL_UNITS[unit]}, {column} from {name}_{unit})"]


def unit_view(study: str, unit: str) -> list[str]:
    spec, keys = STUDIES[study], SQL_UNITS[unit]
    rates = f"v_{unit}_rates"
    avoid = ", ".join(f"{AVOID_SQL[a]} as {a}" for a in spec["avoid"])
    return [
        STATE_RATES if unit == "state" else COUNTY_RATES,
        *cost_views(study, unit),
        f"""v_unit as (
  select {keys}, {", ".join(spec["costs"])}, member_month, {avoid},
         ({AVOID_SQL[spec["of"]]}) / nullif(member_month, 0)::double * 12 as pmpy
  from v_cost_{unit} left join {rates} using ({keys}))""",
    ]


def _register_study(study: str) -> None:
    spec = STUDIES[study]
    for unit in ("state", "county"):

        @query(f"cost_{study}_{unit}", with_views("select * from v_unit", *unit_view(study, unit)))
        def by_unit(spark, folder, unit=unit):
            out = doubles(unit_costs(spark, folder, study, unit))
            return out.select(*UNITS[unit], *spec["costs"], "member_month", *spec["avoid"], "pmpy")

    @query(
        f"pmpy_variation_state_{study}",
        with_views(spread_sql("v_unit", "state", {"rate": "pmpy"}), *unit_view(study, "county")),
    )
    def across_counties(spark, folder):
        return variation.spread(
            unit_costs(spark, folder, study, "county"), "state", {"rate": "pmpy"}, ACCURACY
        )

    @query(
        f"pmpy_range_distribution_{study}",
        with_views(
            _distribution_sql("v_spread", ("range_rate",)),
            *unit_view(study, "county"),
            f"v_spread as ({spread_sql('v_unit', 'state', {'rate': 'pmpy'})})",
        ),
    )
    def ranges(spark, folder):
        return variation.distribution(across_counties(spark, folder), ["range_rate"], accuracy=ACCURACY)

    @query(
        f"pmpy_distribution_{study}",
        with_views(_distribution_sql("v_unit", ("pmpy",)), *unit_view(study, "county")),
    )
    def distribution(spark, folder):
        return variation.distribution(
            unit_costs(spark, folder, study, "county"), ["pmpy"], accuracy=ACCURACY
        )

    @query(
        f"pmpy_distribution_states_{study}",
        with_views(_distribution_sql("v_unit", ("pmpy",)), *unit_view(study, "state")),
    )
    def state_distribution(spark, folder):
        return variation.distribution(
            unit_costs(spark, folder, study, "state"), ["pmpy"], accuracy=ACCURACY
        )

    @query(
        f"pmpy_total_{study}",
        with_views(
            f"""select round(sum({spec["of"]}), 4) as {spec["of"]}, cast(sum(member_month) as bigint) as member_month,
                       round(sum({spec["of"]}) / sum(member_month) * 12, 6) as pmpy from v_unit""",
            *unit_view(study, "state"),
        ),
    )
    def total(spark, folder):
        out = cost.pmpy_total(unit_costs(spark, folder, study, "state"), spec["of"])
        return out.withColumns({spec["of"]: F.round(spec["of"], 4), "pmpy": F.round("pmpy", 6)})

    members_sql = [
        COUNTY_RATES,
        LINES,
        *([ip_view("member")] if "inpatient_cost" in spec["costs"] else []),
        *([ed_view("member")] if "total_cost_ed" in spec["costs"] else []),
        *([other_view("member")] if "total_cost_other" in spec["costs"] else []),
        "v_zero as (select m.member_id, m.state, m.fips_code, "
        + ", ".join(f"coalesce({c}, 0.0::double) as {c}" for c in spec["costs"])
        + " from v_member m"
        + "".join(
            f" left join {view} on m.member_id = {view}.member_id"
            for c, view in (("inpatient_cost", "v_ip_member"), ("total_cost_ed", "v_ed_member"), ("total_cost_other", "v_other_member"))
            if c in spec["costs"]
        )
        + ")",
        f"""v_member_cost as (
  select member_id, v_zero.state, v_zero.fips_code, {", ".join(spec["costs"])},
         {", ".join(f"{AVOID_SQL[a]} as {a}" for a in spec["avoid"])},
         ({AVOID_SQL[spec["of"]]}) / nullif(member_month, 0)::double * 12 as pmpy
  from v_zero left join v_county_rates on v_zero.fips_code = v_county_rates.fips_code)""",
    ]

    def member_rows(spark, folder):
        if study == "total":
            parts = [(combined(spark, folder, "member", stays_only=False), COSTS)]
        else:
            parts = [(study_costs(spark, folder, study, "member"), spec["costs"])]
        return cost.member_costs(
            testbed.members(spark, folder).select("beneID", "state", "fips_code"),
            parts,
            percents(spark, folder, "county").drop("state"),
            {"pmpy": spec["of"]},
        )

    @query(f"member_cost_{study}", with_views("select * from v_member_cost", *members_sql))
    def member_cost(spark, folder):
        return doubles(member_rows(spark, folder)).select(
            "member_id", "state", "fips_code", *spec["costs"], *spec["avoid"], "pmpy"
        )

    @query(
        f"pmpy_variation_county_{study}",
        with_views(spread_sql("v_member_cost", "fips_code", {"rate": "pmpy"}), *members_sql),
    )
    def across_members(spark, folder):
        return variation.spread(member_rows(spark, folder), "fips_code", {"rate": "pmpy"})

    @query(
        f"pmpy_range_distribution_members_{study}",
        with_views(
            _distribution_sql("v_spread", ("range_rate",)),
            *members_sql,
            f"v_spread as ({spread_sql('v_member_cost', 'fips_code', {'rate': 'pmpy'})})",
        ),
    )
    def member_ranges(spark, folder):
        return variation.distribution(across_members(spark, folder), ["range_rate"], accuracy=ACCURACY)

    @query(
        f"pmpy_distribution_members_{study}",
        with_views(_distribution_sql("v_member_cost", ("pmpy",)), *members_sql),
    )
    def member_distribution(spark, folder):
        return variation.distribution(member_rows(spark, folder), ["pmpy"], accuracy=ACCURACY)

    @query(
        f"pmpy_quantiles_members_{study}",
        with_views(_distribution_sql("v_member_cost", ("pmpy", *spec["costs"])), *members_sql),
    )
    def member_quantiles(spark, folder):
        """Exact at any number of members: stored once, then counted in bins."""
        rows = writers.stored(member_rows(spark, folder).select("pmpy", *spec["costs"]), "member-costs")
        return selection.exact_quantiles(rows, ["pmpy", *spec["costs"]])


for _study in STUDIES:
    _register_study(_study)


def savings_units(spark, folder):
    county = unit_costs(spark, folder, "total", "county")
    both = cost.with_pmpy(county, {"pmpy_ed": "avoid_ed_cost", "pmpy_ip": "avoid_ip_cost"})
    units = both.select("fips_code", "state", "member_month", "pmpy_ed", "pmpy_ip")
    return cost.savings_to_median(units, accuracy=ACCURACY)


SAVINGS = [
    *unit_view("total", "county"),
    """v_pmpy as (
  select fips_code, state, member_month, avoid_ed_cost / nullif(member_month, 0)::double * 12 as pmpy_ed,
         avoid_ip_cost / nullif(member_month, 0)::double * 12 as pmpy_ip from v_unit)""",
    """v_saving as (
  select p.*, pmpy_ed_med, pmpy_ip_med,
         case when pmpy_ed > pmpy_ed_med then (pmpy_ed - pmpy_ed_med) * (1.0::double / 12) * member_month else 0.0::double end as saving_ed,
         case when pmpy_ip > pmpy_ip_med then (pmpy_ip - pmpy_ip_med) * (1.0::double / 12) * member_month else 0.0::double end as saving_ip
  from v_pmpy p join (select state, quantile_disc(pmpy_ed, 0.5) as pmpy_ed_med, quantile_disc(pmpy_ip, 0.5) as pmpy_ip_med
                      from v_pmpy group by state) m on p.state = m.state)""",
]


@query("savings_inputs_distribution", with_views(_distribution_sql("v_pmpy", ("pmpy_ed", "pmpy_ip")), *SAVINGS))
def savings_inputs_distribution(spark, folder):
    return variation.distribution(savings_units(spark, folder), ["pmpy_ed", "pmpy_ip"], accuracy=ACCURACY)


SUMMARY_COLUMNS = """round(sum(saving_ed), 4) as saving_ed, round(sum(saving_ip), 4) as saving_ip,
       cast(sum(member_month) as bigint) as months, round(sum(saving_ip) / sum(member_month) * 12, 6) as pmpy_ip_saving,
       round(sum(saving_ed) / sum(member_month) * 12, 6) as pmpy_ed_saving,
       round(sum(saving_ed) + sum(saving_ip), 4) as saving_total,
       round((sum(saving_ed) + sum(saving_ip)) / sum(member_month) * 12, 6) as pmpy_total_saving"""


def rounded(df):
    """Sums of doubles depend on order in the last digits: compare fewer."""
    digits = {
        "saving_ed": 4, "saving_ip": 4, "saving_total": 4,
        "pmpy_ip_saving": 6, "pmpy_ed_saving": 6, "pmpy_total_saving": 6,
    }
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("savings_unit", with_views("select * from v_saving", *SAVINGS))
def savings_unit(spark, folder):
    return savings_units(spark, folder)


@query("savings_state", with_views(f"select state, grouping(state) = 1 as is_total, {SUMMARY_COLUMNS} from v_saving group by rollup (state)", *SAVINGS))
def savings_state(spark, folder):
    return rounded(cost.savings_summary(savings_units(spark, folder), "state", with_total=True))


@query("savings_total", with_views(f"select {SUMMARY_COLUMNS} from v_saving", *SAVINGS))
def savings_total(spark, folder):
    return rounded(cost.savings_summary(savings_units(spark, folder)))


EXTRACTS = {
    "total": (geography.TOTAL_SPEND_COLUMNS, geography.TOTAL_SPEND_RENAMES),
    "ed": (geography.ED_SPEND_COLUMNS, geography.ED_SPEND_RENAMES),
    "ip": (geography.IP_SPEND_COLUMNS, geography.IP_SPEND_RENAMES),
}


def _register_extract(study: str) -> None:
    columns, renames = EXTRACTS[study]

    @query(
        f"spend_extract_{study}",
        with_views(
            "select " + ", ".join(f"{c} as {renames.get(c, c)}" for c in columns) + " from v_unit",
            *unit_view(study, "county"),
        ),
    )
    def extract(spark, folder):
        return geography.release(unit_costs(spark, folder, study, "county"), columns, renames)


for _study in EXTRACTS:
    _register_extract(_study)


@query(
    "savings_distribution",
    with_views(
        " union all ".join(
            f"select '{c}' as measure, {p}::double as point, round({_quantile(c, p)}, 6) as value from v_state_saving"
            for c in ("pmpy_ed_saving", "pmpy_ip_saving")
            for p in codes.QUARTILES
        ),
        *SAVINGS,
        f"v_state_saving as (select state, {SUMMARY_COLUMNS} from v_saving group by state)",
    ),
)
def savings_distribution(spark, folder):
    states = rounded(cost.savings_summary(savings_units(spark, folder), "state"))
    return variation.distribution(states, ["pmpy_ed_saving", "pmpy_ip_saving"], accuracy=ACCURACY)
