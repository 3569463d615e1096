"""Cohort selection and its audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import codes
from ...operators import cohort, panel as panel_ops
from ...sources import readers
from ..testbed import SEGMENT_COUNTY, OTHER_COUNTY, _mapped, table, with_views
from .panel import PANEL, enrolment
from .registry import query


@query(
    "single_state_members",
    """select o_custkey as member_id, date_trunc('month', o_orderdate)::date as month, o_orderkey as claim_id, o_orderstatus
       from orders qualify count(*) over (partition by o_custkey, date_trunc('month', o_orderdate)) = 1""",
)
def single_state_members(spark, folder):
    # Members with exactly one order in a month; the others of that month are left out.
    rows = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("member_id"), F.trunc("o_orderdate", "month").alias("month"),
        F.col("o_orderkey").alias("claim_id"), "o_orderstatus",
    )
    return cohort.single_state_members(rows, ["member_id", "month"])


@query(
    "member_months",
    with_views(
        """select member_id, state, count(*) filter (dual = 'yes') as dual_months,
                  count(*) filter (med_enroll = 'yes') as member_months
           from v_labels where enrolled <> 'no' group by member_id, state""",
        PANEL,
    ),
)
def member_months(spark, folder):
    kept = panel_ops.covered_months(panel_ops.enrolment_labels(enrolment(spark, folder)))
    return panel_ops.member_months(kept).withColumnsRenamed(
        {"beneID": "member_id", "medicareMonths": "dual_months", "medicaidMonths": "member_months"}
    )


FIPS_STATE = """case c_nationkey when 1 then 'AL' when 2 then 'AK' when 4 then 'AZ' when 5 then 'AR' when 6 then 'CA'
       when 8 then 'CO' when 9 then 'CT' when 10 then 'DE' when 11 then 'DC' when 12 then 'FL'
       when 13 then 'GA' when 15 then 'HI' when 16 then 'ID' when 17 then 'IL' when 18 then 'IN'
       when 19 then 'IA' when 20 then 'KS' when 21 then 'KY' when 22 then 'LA' when 23 then 'ME'
       when 24 then 'MD' end"""
# Customers as members with postal states; every tenth one also appears in a second state.
PEOPLE = f"""v_people as (
  select c_custkey as k, {FIPS_STATE} as state,
         case when c_custkey % 17 <> 0 then cast(c_custkey % 80 as int) end as age,
         case when c_custkey % 3 = 0 then 'yes' else 'no' end as disabled,
         case when c_custkey % 7 <> 0 then
           case c_mktsegment when 'AUTOMOBILE' then '001' when 'BUILDING' then '003' when 'FURNITURE' then '005'
                when 'HOUSEHOLD' then '007' else '009' end end as county_code
  from customer),
v_months as (
  select o_custkey as k, count(*) filter (o_orderkey % 40 = 0) as dual_months,
         count(*) filter (o_orderkey % 40 <> 0) as member_months from orders group by o_custkey),
v_seen as (select k, state, age, disabled from v_people union all
           select k, 'VA', age, disabled from v_people where k % 10 = 0)"""
NOT_EXCLUDED = (
    "state not in ('AL', 'CT', 'ID', 'KY', 'MA', 'MD', 'MN', 'NE', 'NH', 'NJ', 'NY', 'OK', 'PR', 'RI', 'TN', 'TX', 'UT', 'VI')"
)


def people(spark, folder):
    key = F.col("c_custkey")
    return (
        table(spark, folder, "customer")
        .withColumn("fips_state", F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
        .join(readers.fips_to_state(spark), "fips_state", "left")
        .select(
            key.alias("beneID"), F.col("state_name").alias("state"),
            F.when(key % 17 != 0, (key % 80).cast("int")).alias("age"),
            F.when(key % 3 == 0, "yes").otherwise("no").alias("disabled"),
            F.when(key % 7 != 0, _mapped("c_mktsegment", SEGMENT_COUNTY, OTHER_COUNTY)).alias("county_code"),
        )
    )


def seen(spark, folder):
    rows = people(spark, folder).drop("county_code")
    states = F.when(F.col("beneID") % 10 == 0, F.array("state", F.lit("VA"))).otherwise(F.array("state"))
    return rows.withColumn("state", F.explode(states))


def months(spark, folder):
    states = people(spark, folder).select("beneID", "state")
    counted = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("beneID")).agg(
        F.count_if(F.col("o_orderkey") % 40 == 0).alias("medicareMonths"),
        F.count_if(F.col("o_orderkey") % 40 != 0).alias("medicaidMonths"),
    )
    return counted.join(states, "beneID")


@query(
    "cohort_filter",
    f"""with {PEOPLE}
        select v_people.k as member_id, state, age, dual_months, member_months
        from v_people join v_months on v_people.k = v_months.k
        where {NOT_EXCLUDED} and dual_months = 0 and age < 65""",
)
def cohort_filter(spark, folder):
    known = people(spark, folder).select("beneID", "state", "age")
    members = cohort.without_states(known).join(months(spark, folder), ["beneID", "state"])
    return cohort.eligible(members).withColumnsRenamed(
        {"beneID": "member_id", "medicareMonths": "dual_months", "medicaidMonths": "member_months"}
    )


@query(
    "study_sample",
    f"""with {PEOPLE}
        select p.k as member_id, p.state, p.age, p.disabled, dual_months, member_months, county_code,
               lpad(cast(c_nationkey as varchar), 2, '0') as fips_state,
               lpad(cast(c_nationkey as varchar), 2, '0') || county_code as fips_code
        from v_people p join v_months on p.k = v_months.k join customer on c_custkey = p.k
        where p.k in (select k from v_seen group by k having count(*) = 1) and {NOT_EXCLUDED}
          and dual_months = 0 and age < 65 and county_code is not null""",
)
def study_sample(spark, folder):
    county = people(spark, folder).select("beneID", "state", "county_code")
    sample = cohort.study_sample(
        seen(spark, folder), months(spark, folder), county, readers.state_to_fips(spark)
    )
    return sample.select(
        F.col("beneID").alias("member_id"), "state", "age", "disabled",
        F.col("medicareMonths").alias("dual_months"), F.col("medicaidMonths").alias("member_months"),
        "county_code", "fips_state", "fips_code",
    )


@query(
    "cohort_funnel",
    f"""with {PEOPLE}, v_one as (
          select k, min(state) as state, max(age) as age, count(*) as n from v_seen group by k),
        v_joined as (select v_one.*, dual_months from v_one left join v_months on v_one.k = v_months.k),
        v_step as (
          select *, case when n <> 1 then 0 when state is null then 1 when not ({NOT_EXCLUDED}) then 2
                         when dual_months is null or dual_months <> 0 then 3
                         when age is null or age >= 65 then 4 else 5 end as passed from v_joined)
        select s.step, s.name, cast(sum(n) as bigint) as rows, count(distinct state) as groups
        from v_step join (values (0, 'all'), (1, 'one state'), (2, 'state known'), (3, 'state kept'),
                                 (4, 'never dual'), (5, 'under 65')) s(step, name) on s.step <= passed
        group by s.step, s.name""",
)
def cohort_funnel(spark, folder):
    counted = seen(spark, folder).groupBy("beneID").agg(
        F.min("state").alias("state"), F.max("age").alias("age"), F.count(F.lit(1)).alias("records")
    )
    members = counted.join(months(spark, folder).drop("state"), "beneID", "left")
    steps = (
        ("one state", F.col("records") == 1),
        ("state known", F.col("state").isNotNull()),
        ("state kept", ~F.col("state").isin(*codes.EXCLUDED_STATES)),
        ("never dual", F.col("medicareMonths") == 0),
        ("under 65", F.col("age") < 65),
    )
    return cohort.funnel(members, steps, "state", weight="records")
