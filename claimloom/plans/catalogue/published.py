"""Queries with the published codes and field lists as they are, on coded columns made from the test tables.

The SQL writes every code and field out once more, so that a wrong entry in the
library's lists shows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import codes
from ...functions.columns import census_region, ed_visit, flag
from ...operators import claims, panel, rates
from .. import testbed
from ..testbed import table
from .panel import DEMO
from .registry import query

# Column of a claim file -> (step, modulus): a line holds the field where (part + step * supplier) % modulus = 0.
FIELD_RULES = {
    "PRCDR_CD_1": (1, 3), "DGNS_CD_1": (2, 2), "SRVC_PRVDR_NPI": (3, 5), "SRVC_PRVDR_SPCLTY_CD": (4, 7), "DRG_CD": (5, 3),
    "SRVC_BGN_DT": (6, 2), "SRVC_END_DT": (7, 2), "BLG_PRVDR_NPI": (8, 9), "BLG_PRVDR_SPCLTY_CD": (9, 11), "LINE_PRCDR_CD": (10, 3),
    "LINE_MDCD_PD_AMT": (11, 4), "LINE_MDCD_FFS_EQUIV_AMT": (12, 5), "BILLED_AMT": (13, 6), "MDCR_PD_AMT": (14, 7), "MDCD_PD_AMT": (15, 8),
    "MDCD_COPAY_AMT": (16, 9), "LINE_COPAY_AMT": (17, 5), "LINE_MDCR_PD_AMT": (18, 6),
}


def coded_lines(spark, folder):
    """Lines of claims with every field of the completeness reports, some empty."""
    item = table(spark, folder, "lineitem")
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    fields = {c: F.when((part + step * supplier) % modulus == 0, F.lit("x")) for c, (step, modulus) in FIELD_RULES.items()}
    return item.select(
        (F.col("l_orderkey") % 1000).alias("BENE_ID"), F.col("l_returnflag").alias("STATE_CD"), F.col("l_orderkey").alias("CLM_ID"),
        *[c.alias(n) for n, c in fields.items()],
    )


def _claim_sql(**fields: str) -> str:
    """A view of claims: whether any line of a claim holds each field."""
    tests = ", ".join(
        f"max(case when (l_partkey + {FIELD_RULES[c][0]} * l_suppkey) % {FIELD_RULES[c][1]} = 0 then 1 else 0 end) as {name}"
        for name, c in fields.items()
    )
    return f"""with c as (select l_returnflag as state, {tests} from lineitem group by l_orderkey % 1000, l_returnflag, l_orderkey)"""


PROVIDER = "(npi = 1 or spec = 1 or bill_npi = 1 or bill_spec = 1)"


@query(
    "inpatient_completeness_published",
    _claim_sql(
        proc="PRCDR_CD_1", diag="DGNS_CD_1", npi="SRVC_PRVDR_NPI", spec="SRVC_PRVDR_SPCLTY_CD", drg="DRG_CD", begins="SRVC_BGN_DT",
        ends="SRVC_END_DT", bill_npi="BLG_PRVDR_NPI", bill_spec="BLG_PRVDR_SPCLTY_CD",
    )
    + f""" select state as "STATE_CD", grouping(state) = 1 as is_total,
      count(*) filter (begins = 1 and ends = 1 and diag = 1 and {PROVIDER} and proc = 1 and drg = 1) as "all",
      count(*) filter (begins = 1 and ends = 1 and diag = 1 and {PROVIDER} and drg = 1) as "noProc",
      count(*) filter (begins = 1 and ends = 1 and diag = 1 and {PROVIDER}) as "noProcDrg", count(*) as "totalClaims"
      from c group by rollup (state)""",
)
def inpatient_completeness(spark, folder):
    return claims.completeness(
        coded_lines(spark, folder), claims.INPATIENT_FIELDS, claims.inpatient_checks(), by=["STATE_CD"], with_total=True
    )


@query(
    "other_completeness_published",
    _claim_sql(
        proc="LINE_PRCDR_CD", diag="DGNS_CD_1", npi="SRVC_PRVDR_NPI", spec="SRVC_PRVDR_SPCLTY_CD", bill_npi="BLG_PRVDR_NPI",
        bill_spec="BLG_PRVDR_SPCLTY_CD",
    )
    + f""" select state as "STATE_CD", grouping(state) = 1 as is_total,
      count(*) filter (proc = 1 and diag = 1 and {PROVIDER}) as "noMissing", count(*) as "totalClaims" from c group by rollup (state)""",
)
def other_completeness(spark, folder):
    return claims.completeness(
        coded_lines(spark, folder), claims.OTHER_FIELDS, claims.other_checks(), by=["STATE_CD"], with_total=True
    )


@query(
    "inpatient_payments_published",
    _claim_sql(
        paid="LINE_MDCD_PD_AMT", equivalent="LINE_MDCD_FFS_EQUIV_AMT", billed="BILLED_AMT", medicare="MDCR_PD_AMT", medicaid="MDCD_PD_AMT",
        copay="MDCD_COPAY_AMT",
    )
    + """ select cast(sum(paid) as bigint) as "linePaidNotNull", cast(sum(equivalent) as bigint) as "lineFfsEquivAmountNN",
      cast(sum(billed) as bigint) as "headBilledNotNull", cast(sum(medicare) as bigint) as "headMdcrNotNull",
      cast(sum(medicaid) as bigint) as "headMdcdNotNull", cast(sum(copay) as bigint) as "headBeneNotNull",
      count(*) filter (medicare = 1 or medicaid = 1 or copay = 1) as "headTotPaidNotNull", count(*) as "totalClaims" from c""",
)
def inpatient_payments(spark, folder):
    return claims.completeness(
        coded_lines(spark, folder), claims.INPATIENT_PAYMENTS, any_of=claims.INPATIENT_ANY_PAYMENT
    )


@query(
    "other_payments_published",
    _claim_sql(copay="LINE_COPAY_AMT", medicare="LINE_MDCR_PD_AMT", medicaid="LINE_MDCD_PD_AMT")
    + """ select cast(sum(copay) as bigint) as "LineBeneCopayNotNull", cast(sum(medicare) as bigint) as "LineMdcrPaidNotNull",
      cast(sum(medicaid) as bigint) as "LineMdcdPaidNotNull",
      count(*) filter (copay = 1 or medicare = 1 or medicaid = 1) as "LinePaidNotNull", count(*) as "totalClaims" from c""",
)
def other_payments(spark, folder):
    return claims.completeness(coded_lines(spark, folder), claims.OTHER_PAYMENTS, any_of=claims.OTHER_ANY_PAYMENT)


@query(
    "ed_visit_published",
    """with c as (
      select l_orderkey as claim_id, l_linenumber as line_num,
        case when l_partkey % 11 = 0 then '0981' when l_partkey % 5 <> 0 then lpad(cast(440 + l_partkey % 25 as varchar), 4, '0') end as rev,
        case when l_suppkey % 2 = 0 then lpad(cast(l_suppkey % 30 as varchar), 2, '0') when l_suppkey % 3 = 0 then '0' || cast(l_suppkey % 30 as varchar) end as pos,
        case when l_partkey % 4 <> 0 then cast(99275 + (l_partkey + l_suppkey) % 15 as varchar) end as proc
      from lineitem)
    select claim_id, line_num, case when
      rev in ('0450', '0451', '0452', '0453', '0454', '0456', '0457', '0458', '0459', '0981') or pos in ('23', '023')
      or proc in ('99281', '99282', '99283', '99284', '99285') then 1 else 0 end as ed_visit from c""",
)
def ed_visits(spark, folder):
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    place = (supplier % 30).cast("string")
    coded = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("line_num"),
        F.when(part % 11 == 0, "0981").when(part % 5 != 0, F.lpad((440 + part % 25).cast("string"), 4, "0")).alias("REV_CNTR_CD"),
        F.when(supplier % 2 == 0, F.lpad(place, 2, "0")).when(supplier % 3 == 0, F.concat(F.lit("0"), place)).alias("POS_CD"),
        F.when(part % 4 != 0, (99275 + (part + supplier) % 15).cast("string")).alias("LINE_PRCDR_CD"),
    )
    return coded.select("claim_id", "line_num", flag(ed_visit()).alias("ed_visit"))


# The columns of the published table of characteristics.
CHARACTERISTICS = (
    "ageCat", "sex", "race", "censusRegion", "houseSize", "fedPovLine", "speakEnglish", "married", "UsCitizen", "ssi", "ssdi", "tanf", "disabled",
)

STATE_OF = "list_extract([" + ", ".join(f"'{s}'" for s in codes.STATE_FIPS) + f"], cast({{key}} % {len(codes.STATE_FIPS)} as int) + 1)"
REGION_CASE = """case when {state} in ('AZ', 'HI', 'WA', 'OR', 'CA', 'MT', 'ID', 'NV', 'WY', 'UT', 'CO', 'NM'{west}) then 'West'
  when {state} in ('ND', 'SD', 'NE', 'KS', 'MN', 'MO', 'WI', 'IL', 'MI', 'IN', 'OH'{midwest}) then 'Midwest'
  when {state} in ('PA', 'NY', 'NJ', 'VT', 'NH', 'MA', 'CT', 'RI', 'ME') then 'Northeast' else 'South' end"""


def postal(key):
    return F.element_at(F.array(*[F.lit(s) for s in codes.STATE_FIPS]), (F.col(key) % len(codes.STATE_FIPS)).cast("int") + 1)


@query(
    "census_region_published",
    f"""select state, {REGION_CASE.format(state='state', west=", 'AK'", midwest=", 'IA'")} as region,
      {REGION_CASE.format(state='state', west='', midwest='')} as region_as_published, count(*) as members
      from (select {STATE_OF.format(key='c_custkey')} as state from customer) group by state""",
)
def census_regions(spark, folder):
    states = table(spark, folder, "customer").select(postal("c_custkey").alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("members"))
    return states.select(
        "state", census_region("state").alias("region"), census_region("state", legacy=True).alias("region_as_published"), "members"
    )


@query(
    "characteristics_published",
    "with " + DEMO + ", v_thirteen as (select *, "
    + REGION_CASE.format(state=STATE_OF.format(key='"beneID"'), west=", 'AK'", midwest=", 'IA'")
    + ' as "censusRegion" from v_demo), v_cells as ('
    + " union all ".join(f"""select '{c}' as variable, cast("{c}" as varchar) as level from v_thirteen""" for c in CHARACTERISTICS)
    + """) select variable, level, count(*) as "Count",
      round(count(*)::double / (select count(*) from customer) * 100, 1) as "Percentage" from v_cells group by variable, level""",
)
def characteristics(spark, folder):
    people = panel.demographics(testbed.raw_demographics(spark, folder)).withColumn("censusRegion", census_region(postal("beneID")))
    return rates.describe_categories(people, CHARACTERISTICS)
