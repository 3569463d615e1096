"""Enrolment panel, recodes and completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import codes
from ...functions.columns import any_all_flag, bands, census_region, county_key, recode
from ...operators import adjust, audit, claims as claim_ops, panel
from .. import testbed
from ..testbed import table, with_views
from .episodes import claims
from .registry import query

PANEL_KEYS = {"BENE_ID": "beneID", "STATE_CD": "state"}
PANEL = """
v_month as (
  select o_custkey as k, month(o_orderdate) as m, cast(sum(cast(o_orderkey % 4 * 10 as int)) as bigint) as med_days,
         cast(sum(cast(o_orderkey % 3 * 5 as int)) as bigint) as chip_days,
         max(lpad(cast(o_orderkey % 23 as varchar), 2, '0')) as plan,
         max(cast(o_orderkey % 6 as varchar)) as chip, max(lpad(cast(o_orderkey % 12 as varchar), 2, '0')) as dual_code
  from orders group by o_custkey, month(o_orderdate)),
v_panel as (
  select p.k as member_id, v_member.state, cast(n.m as varchar) as month, med_days, chip_days, plan, chip, dual_code
  from (select distinct o_custkey as k from orders) p cross join (select unnest(range(1, 13)) as m) n
  join v_member on v_member.member_id = p.k
  left join v_month on v_month.k = p.k and v_month.m = n.m),
v_labels as (
  select *, case when med_days > 0 then 'yes' when med_days = 0 then 'no' else 'missing' end as med_enroll,
         case when chip_days > 0 then 'yes' when chip_days = 0 then 'no' else 'missing' end as chip_enroll,
         case when med_days > 0 then 'yes' else 'no' end as enrolled,
         case when dual_code = '00' then 'no'
              when dual_code in ('01','02','03','04','05','06','08','09','10') then 'yes' else 'missing' end as dual,
         case when plan in ('01','02','03','04','06','07','08','09','12','14','15','16','17','20','60','70','80')
              then 'yes' else 'no' end as managed_care,
         case chip when '0' then 'neither' when '1' then 'medicaid' when '2' then 'chip' when '3' then 'chip'
              when '4' then 'both' else 'missing' end as coverage
  from v_panel)"""


def enrolment(spark, folder):
    return panel.monthly_panel(testbed.wide_enrolment(spark, folder), PANEL_KEYS)


@query(
    "monthly_panel",
    with_views(
        "select member_id, state, month, med_days, chip_days, plan, chip, dual_code from v_panel", PANEL
    ),
)
def monthly_panel(spark, folder):
    return enrolment(spark, folder).withColumnsRenamed(
        {
            "beneID": "member_id", "medicaidDays": "med_days", "chipDays": "chip_days",
            "mcPlanType": "plan", "chipCode": "chip", "dualStatus": "dual_code",
        }
    )


@query(
    "unpivot_months",
    """select c.nation, m.month, count(o_orderkey) filter (month(o_orderdate) = cast(m.month as int)) as claims
       from (select distinct c_nationkey as nation from customer join orders on c_custkey = o_custkey) c
       cross join (select cast(unnest(range(1, 13)) as varchar) as month) m
       join customer on c_nationkey = c.nation join orders on o_custkey = c_custkey
       group by c.nation, m.month""",
)
def unpivot_months(spark, folder):
    orders = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    wide = orders.groupBy(F.col("c_nationkey").alias("nation")).agg(
        *[F.count_if(F.month("o_orderdate") == m).alias(f"claims_{m:02d}") for m in range(1, 13)]
    )
    columns = {f"claims_{m:02d}": str(m) for m in range(1, 13)}
    return panel.one_measure_panel(wide, ["nation"], columns, "month", "claims")


@query(
    "enrolment_status",
    with_views(
        """select member_id, month, med_enroll, chip_enroll, enrolled, dual, managed_care, coverage from v_labels""",
        PANEL,
    ),
)
def enrolment_status(spark, folder):
    return panel.enrolment_labels(enrolment(spark, folder)).select(
        F.col("beneID").alias("member_id"), "month", F.col("medEnroll").alias("med_enroll"),
        F.col("chipEnroll").alias("chip_enroll"), "enrolled", "dual",
        F.col("managedCare").alias("managed_care"), F.col("coverageType").alias("coverage"),
    )


@query(
    "covered_months",
    with_views("select member_id, state, month from v_labels where enrolled <> 'no'", PANEL),
)
def covered_months(spark, folder):
    kept = panel.covered_months(panel.enrolment_labels(enrolment(spark, folder)))
    return kept.select(F.col("beneID").alias("member_id"), "state", "month")


@query(
    "recode_table",
    """select o_orderkey as claim_id,
              case o_orderstatus when 'F' then 'closed' when 'O' then 'open' else 'missing' end as status,
              case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'high'
                   when o_orderpriority in ('3-MEDIUM') then 'middle' else 'missing' end as priority,
              case when o_orderkey % 9 in (1, 2) then 'a' when o_orderkey % 9 = 7 then 'b' else 'missing' end as code
       from orders""",
)
def recode_table(spark, folder):
    padded = F.lpad((F.col("o_orderkey") % 9).cast("string"), 2, "0")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("claim_id"),
        recode("o_orderstatus", {"closed": ("F",), "open": ("O",)}).alias("status"),
        recode("o_orderpriority", {"high": ("1-URGENT", "2-HIGH"), "middle": ("3-MEDIUM",)}).alias("priority"),
        recode(padded, {"a": (1, 2), "b": (7,)}).alias("code"),
    )


AGE_CASE = """case when age is null then 'missing' when age < 10 then 'under10' when age < 18 then '10To17' when age < 30 then '18To29'
                   when age < 40 then '30To39' when age < 50 then '40To49' when age < 65 then '50To64' else 'over64' end"""


@query(
    "recode_bands",
    f"""select member_id, {AGE_CASE} as "ageCat",
               case when nation in (1, 2) then 'West' when nation in (3) then 'Midwest' else 'South' end as region
        from (select c_custkey as member_id, c_nationkey as nation,
                     case when c_custkey % 17 <> 0 then (c_custkey % 160) / 2.0 end as age from customer)""",
)
def recode_bands(spark, folder):
    key = F.col("c_custkey")
    state = F.when(F.col("c_nationkey").isin(1, 2), "AK").when(F.col("c_nationkey") == 3, "IA").otherwise("VA")
    return table(spark, folder, "customer").select(
        key.alias("member_id"),
        bands(F.when(key % 17 != 0, (key % 160) / 2)).alias("ageCat"),
        census_region(state).alias("region"),
    )


@query(
    "any_all_flag",
    """select c_custkey as member_id,
              case when a = 1 or b = 1 or c = 1 then 'yes' when a = 0 and b = 0 and c = 0 then 'no' else 'missing' end as disabled
       from (select c_custkey, case when c_custkey % 5 <> 0 then cast(c_custkey % 7 = 1 as int) end as a,
                    case when c_custkey % 3 <> 0 then cast(c_custkey % 11 = 1 as int) end as b,
                    cast(c_custkey % 13 = 1 as int) as c from customer)""",
)
def any_all(spark, folder):
    key = F.col("c_custkey")
    flags = table(spark, folder, "customer").select(
        key.alias("member_id"),
        F.when(key % 5 != 0, (key % 7 == 1).cast("double")).alias("a"),
        F.when(key % 3 != 0, (key % 11 == 1).cast("double")).alias("b"),
        (key % 13 == 1).cast("double").alias("c"),
    )
    return flags.select("member_id", any_all_flag(["a", "b", "c"]).alias("disabled"))


def _demo_code(divisor: int, width: int, modulus: int) -> str:
    return (
        f"case when c_custkey % 13 <> {divisor % 13} then "
        f"lpad(cast((c_custkey // {divisor}) % {modulus} as varchar), {width}, '0') end"
    )


def _demo_sql() -> str:
    # written out, so that a wrong code in the engine's tables shows
    yes_no = "when v = '1' then 'yes' when v = '0' then 'no'"
    recodes = {
        "death": ((2, 1, 3), yes_no),
        "race": ((3, 1, 9), "when v = '1' then 'white' when v = '2' then 'black' when v = '3' then 'asian' when v = '4' then 'native' "
                            "when v = '5' then 'hawaiian' when v = '6' then 'multiracial' when v = '7' then 'hispanic'"),
        "speakEnglish": ((4, 1, 5), "when v in ('0', '1') then 'yes' when v in ('2', '3') then 'no'"),
        "married": ((5, 2, 16), "when v between '01' and '08' then 'yes' when v between '09' and '14' then 'no'"),
        "houseSize": ((6, 2, 10), "when v = '01' then 'single' when v between '02' and '05' then 'twoToFive' "
                                  "when v between '06' and '08' then 'sixorMore'"),
        "fedPovLine": ((7, 2, 10), "when v = '01' then '0To100' when v between '02' and '04' then '100To200' "
                                   "when v between '05' and '08' then '200AndMore'"),
        "UsCitizen": ((8, 1, 3), yes_no),
        "ssdi": ((9, 1, 3), yes_no),
        "ssi": ((10, 1, 3), yes_no),
        "tanf": ((11, 1, 4), "when v = '2' then 'yes' when v in ('0', '1') then 'no'"),
    }
    columns = []
    for name, (source, arms) in recodes.items():
        arms = arms.replace("when v ", f"when ({_demo_code(*source)}) ")
        columns.append(f"case {arms} else 'missing' end as \"{name}\"")
    flags = [
        f"case when c_custkey % 11 <> {i} then cast((c_custkey // {i + 2}) % {i + 3} = 0 as int) end" for i in range(7)
    ]
    disabled = "case when {} then 'yes' when {} then 'no' else 'missing' end".format(
        " or ".join(f"({f}) = 1" for f in flags), " and ".join(f"({f}) = 0" for f in flags)
    )
    age = "case when c_custkey % 17 <> 0 then cast(c_custkey % 80 as int) end"
    return f"""v_demo as (
      select c_custkey as "beneID", cast(c_nationkey as varchar) as state,
             lpad(cast(c_nationkey as varchar), 2, '0') || case when c_custkey % 7 <> 0 then
               case c_mktsegment when 'AUTOMOBILE' then '001' when 'BUILDING' then '003' when 'FURNITURE' then '005'
                    when 'HOUSEHOLD' then '007' else '009' end end as county,
             lpad(cast(c_custkey % 997 as varchar), 5, '0') as "zipCode", {age} as age,
             {AGE_CASE.replace('age ', f'({age}) ')} as "ageCat",
             case c_custkey % 3 when 0 then 'male' when 1 then 'female' else 'missing' end as sex,
             {", ".join(columns)}, {disabled} as disabled
      from customer)"""


DEMO = _demo_sql()
DEMO_COLUMNS = ("age", "ageCat", "sex", *codes.DEMOGRAPHIC_RECODES, "disabled")
DEMO_COLUMNS = tuple(dict.fromkeys(DEMO_COLUMNS))


@query(
    "demographics",
    "with " + DEMO + ' select "beneID", state, county, "zipCode", '
    + ", ".join(f'"{c}"' for c in DEMO_COLUMNS) + " from v_demo",
)
def demographics(spark, folder):
    recoded = panel.demographics(testbed.raw_demographics(spark, folder))
    return panel.member_demographics(recoded).select("beneID", "state", "county", "zipCode", *DEMO_COLUMNS)


@query(
    "county_key",
    """select c_custkey as member_id, lpad(cast(c_nationkey as varchar), 2, '0') || nullif(c_mktsegment, 'BUILDING') as county
       from customer""",
)
def county(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("member_id"),
        county_key(
            F.lpad(F.col("c_nationkey").cast("string"), 2, "0"),
            F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")),
        ).alias("county"),
    )


@query(
    "member_collapse",
    """select o_custkey as member_id, max(o_orderstatus) as status, max(o_orderpriority) as priority,
              max(o_totalprice) as paid from orders group by o_custkey""",
)
def member_collapse(spark, folder):
    from ...operators.relational import one_row_per

    rows = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("member_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("paid"),
    )
    return one_row_per(rows, "member_id")


# Every seventh member is known under another identifier, so some rows find no match.
MATCHED = """v_known as (select case when member_id % 7 = 0 then -member_id else member_id end as member_id, age, region from v_member)"""


@query(
    "panel_demographics",
    with_views(
        """select p.member_id, p.month, k.age, k.region, case when k.member_id is null then 0 else 1 end as matched
           from v_labels p left join v_known k on p.member_id = k.member_id where p.enrolled <> 'no'""",
        PANEL, MATCHED,
    ),
)
def panel_demographics(spark, folder):
    kept = panel.covered_months(panel.enrolment_labels(enrolment(spark, folder)))
    return attached(spark, folder, kept).select(
        F.col("beneID").alias("member_id"), "month", "age", "region", "matched"
    )


def attached(spark, folder, rows):
    renamed = F.when(F.col("beneID") % 7 == 0, -F.col("beneID")).otherwise(F.col("beneID"))
    known = testbed.members(spark, folder).select(renamed.alias("beneID"), "age", "region")
    return panel.attach_demographics(rows, known, ["beneID"], matched="matched")


@query(
    "match_rate",
    with_views(
        """select count(*) as rows, count(k.member_id) as matched,
                  count(k.member_id) * 100.0::double / count(*) as percent_matched
           from v_header h left join v_known k on h.member_id = k.member_id""",
        MATCHED,
    ),
)
def match_rate(spark, folder):
    out = audit.match_rate(attached(spark, folder, testbed.headers(spark, folder)), "matched")
    return out.withColumn("percent_matched", F.col("matched") * F.lit(100.0) / F.col("rows"))


# Fields of the testbed claims with some values blanked, for the completeness counts.
BLANKED = """v_blank as (
  select claim_id, state, case when line_num % 3 <> 0 then proc_code end as proc,
         case when claim_id % 5 <> 0 then dx end as diag, case when claim_id % 7 <> 0 then rev_code end as npi,
         case when line_num % 2 = 0 then place_code end as spec,
         case when claim_id % 11 <> 0 then line_paid end as paid, case when claim_id % 13 <> 0 then header_paid end as head
  from v_claim join v_member on v_claim.member_id = v_member.member_id)"""
FIELDS = {"procNotNull": "proc", "diagNotNull": "diag", "npiNotNull": "npi", "specCodeNotNull": "spec"}
PAYMENTS = {"linePaidNotNull": "paid", "headMdcdNotNull": "head"}


def blanked(spark, folder):
    people = testbed.members(spark, folder).select("beneID", "state")
    number, claim = F.col("LINE_NUM"), F.col("CLM_ID")
    return claims(spark, folder).join(people, "beneID").select(
        F.col("CLM_ID").alias("claim_id"), "state",
        F.when(number % 3 != 0, F.col("proc_code")).alias("proc"),
        F.when(claim % 5 != 0, F.col("DGNS_CD_1")).alias("diag"),
        F.when(claim % 7 != 0, F.col("rev_code")).alias("npi"),
        F.when(number % 2 == 0, F.col("place_code")).alias("spec"),
        F.when(claim % 11 != 0, F.col("line_paid")).alias("paid"),
        F.when(claim % 13 != 0, F.col("MDCD_PD_AMT")).alias("head"),
    )


@query(
    "payment_completeness",
    with_views(
        """select count(paid) as "linePaidNotNull", count(head) as "headMdcdNotNull",
                  count(*) filter (paid is not null or head is not null) as "anyPaid", count(*) as "totalClaims"
           from (select claim_id, state, max(paid) as paid, max(head) as head from v_blank group by claim_id, state)""",
        BLANKED,
    ),
)
def payment_completeness(spark, folder):
    return claim_ops.completeness(
        blanked(spark, folder), PAYMENTS, keys=["claim_id", "state"],
        any_of={"anyPaid": tuple(PAYMENTS)},
    )


def _checks():
    provider = (F.col("npiNotNull") == 1) | (F.col("specCodeNotNull") == 1)
    dated = (F.col("diagNotNull") == 1) & provider
    return {"all": dated & (F.col("procNotNull") == 1), "noProc": dated}


CLAIM_LEVEL = """v_claim_level as (
  select claim_id, state, max(proc) as proc, max(diag) as diag, max(npi) as npi, max(spec) as spec
  from v_blank group by claim_id, state)"""


@query(
    "completeness_by_state",
    with_views(
        """select state, grouping(state) = 1 as is_total,
                  count(*) filter (proc is not null and diag is not null and (npi is not null or spec is not null)) as "all",
                  count(*) filter (diag is not null and (npi is not null or spec is not null)) as "noProc",
                  count(*) as "totalClaims"
           from v_claim_level group by rollup (state)""",
        BLANKED, CLAIM_LEVEL,
    ),
)
def completeness_by_state(spark, folder):
    return claim_ops.completeness(
        blanked(spark, folder), FIELDS, _checks(), by=["state"], keys=["claim_id", "state"], with_total=True
    )


@query(
    "line_completeness",
    with_views(
        """select state, count(*) filter (proc is not null and diag is not null and (npi is not null or spec is not null)) as "noMissing",
                  count(*) as "totalClaims"
           from v_claim_level group by state""",
        BLANKED, CLAIM_LEVEL,
    ),
)
def line_completeness(spark, folder):
    return claim_ops.completeness(
        blanked(spark, folder), FIELDS, {"noMissing": _checks()["all"]}, by=["state"],
        keys=["claim_id", "state"],
    )


@query(
    "line_presence",
    with_views(
        """select claim_id, cast(proc is not null as int) as "procNotNull", cast(spec is not null as int) as "specCodeNotNull",
                  cast(paid is not null or head is not null as int) as "anyPaid" from v_blank""",
        BLANKED,
    ),
)
def line_presence(spark, folder):
    flagged = claim_ops.presence_flags(
        blanked(spark, folder), {**FIELDS, **PAYMENTS}, {"anyPaid": tuple(PAYMENTS)}
    )
    return flagged.select("claim_id", "procNotNull", "specCodeNotNull", "anyPaid")


BANDS = ("50To64", "10To17", "40To49", "30To39", "under10", "missing", "18To29")
# Every eleventh member's age is blanked, so that the missing band occurs.
COMPOSITION = f"""v_aged as (
  select state, {AGE_CASE} as band
  from (select member_id, state, case when member_id % 11 <> 0 then age end as age from v_member where age < 65)),
v_comp as (
  select state, count(*) as total,
         {", ".join(f"round(count(*) filter (band = '{b}') / count(*)::double * 100, 1) as p{i}" for i, b in enumerate(BANDS))}
  from v_aged group by state)"""


def age_mix(spark, folder):
    people = testbed.members(spark, folder).where(F.col("age") < 65)
    known = F.when(F.col("beneID") % 11 != 0, F.col("age"))
    return adjust.composition(people.withColumn("ageCat", bands(known)))


@query(
    "age_composition",
    with_views(
        "select state, total, "
        + ", ".join(f'p{i} as "sum_{b}_percentage"' for i, b in enumerate(BANDS))
        + ", round(" + " + ".join(f"p{i}" for i in range(len(BANDS)))
        + ", 1) as total_percentage from v_comp",
        COMPOSITION,
    ),
)
def age_composition(spark, folder):
    return age_mix(spark, folder).withColumn("total_percentage", F.round("total_percentage", 1))


@query(
    "one_hot",
    """select o_orderkey as claim_id, cast(o_orderstatus = 'F' as int) as is_f, cast(o_orderstatus = 'O' as int) as is_o,
              cast(o_orderstatus = 'P' as int) as is_p from orders""",
)
def one_hot(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("claim_id"), F.lower("o_orderstatus").alias("status")
    )
    return adjust.one_hot(orders, "status", ["f", "o", "p"], prefix="is_").drop("status")
