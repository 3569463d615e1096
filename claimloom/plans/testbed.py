"""Claims-shaped views over a star schema of orders and line items.

Customers stand for members, orders for claim headers, line items for claim
lines: the registered queries run the operators on these. ``VIEWS`` states the
same views as SQL for the independent check.
"""

from __future__ import annotations

from functools import wraps
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import inline_table

# Fixed values of the mapping.
SEGMENT_COUNTY = {
    "AUTOMOBILE": "001", "BUILDING": "003", "FURNITURE": "005", "HOUSEHOLD": "007",
}
OTHER_COUNTY = "009"
STATUS_CLAIM_TYPE = {"F": "1", "O": "3"}
OTHER_CLAIM_TYPE = "2"
ED_SIGNALS = {"rev_code": ("R",), "place_code": ("7",), "proc_code": ("PROMO", "ECONOMY")}
ED_SCORES = (
    ("1-URGENT", 0.05, 0.10, 0.05),
    ("2-HIGH", 0.20, 0.20, 0.20),
    ("3-MEDIUM", 0.30, 0.25, 0.20),
    ("5-LOW", 0.40, 0.30, 0.30),
)
IP_LIST = (("3-MEDIUM", "a"), ("4-NOT SPECIFIED", "b"))


_built: WeakKeyDictionary[SparkSession, dict[tuple, DataFrame]] = WeakKeyDictionary()


def per_session(build):
    """Build a view once per session and arguments. A DataFrame is an immutable
    plan, so queries can share it; nothing is computed or held but the plan."""

    @wraps(build)
    def shared(spark: SparkSession, *arguments):
        known = _built.setdefault(spark, {})
        key = (build.__module__, build.__qualname__, *arguments)
        if key not in known:
            known[key] = build(spark, *arguments)
        return known[key]

    return shared


@per_session
def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _mapped(column: str, mapping: dict[str, str], default: str):
    out = None
    for value, label in mapping.items():
        hit = F.col(column) == value
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


@per_session
def members(spark: SparkSession, folder: str) -> DataFrame:
    """beneID, state, region, fips_code, age, medicaidMonths: one row per customer."""
    nation = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    county = _mapped("c_mktsegment", SEGMENT_COUNTY, OTHER_COUNTY)
    return (
        table(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("beneID"),
            F.col("n_name").alias("state"),
            F.col("r_name").alias("region"),
            F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), county).alias("fips_code"),
            (F.col("c_custkey") % 80).cast("int").alias("age"),
            (F.col("c_custkey") % 12 + 1).cast("int").alias("medicaidMonths"),
        )
    )


@per_session
def headers(spark: SparkSession, folder: str, wanted: bool = False) -> DataFrame:
    """Claim headers; ``wanted`` keeps the claim types assembly uses, tested on the stored status."""
    orders = table(spark, folder, "orders")
    if wanted:
        orders = orders.where(F.col("o_orderstatus").isin(*STATUS_CLAIM_TYPE))
    return orders.select(
        F.col("o_custkey").alias("beneID"),
        F.col("o_orderkey").alias("CLM_ID"),
        _mapped("o_orderstatus", STATUS_CLAIM_TYPE, OTHER_CLAIM_TYPE).alias("CLM_TYPE_CD"),
        F.col("o_orderpriority").alias("DGNS_CD_1"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("MDCD_PD_AMT"),
        F.col("o_orderdate").cast("date").alias("claim_date"),
    )


@per_session
def lines(spark: SparkSession, folder: str, parts: bool = True) -> DataFrame:
    """Claim lines; ``parts=False`` leaves out the procedure code and its join."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    item = table(spark, folder, "lineitem")
    procedure = F.lit(None).cast("string")
    if parts:
        item = item.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        procedure = F.col("p_type")
    start = F.col("l_shipdate").cast("date")
    return item.select(
        F.col("l_orderkey").alias("CLM_ID"),
        F.col("l_linenumber").alias("LINE_NUM"),
        F.col("l_linestatus").alias("file_code"),
        F.col("l_returnflag").alias("rev_code"),
        F.col("l_linenumber").cast("string").alias("place_code"),
        procedure.alias("proc_code"),
        price.alias("line_equiv"),
        (price * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)").alias("line_paid"),
        start.alias("StartDate"),
        F.date_add(start, F.col("l_quantity").cast("int")).alias("EndDate"),
    )


@per_session
def ed_scores(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ED_SCORES, ("dx", "ednp", "pct", "nonemergent"))


@per_session
def ip_list(spark: SparkSession) -> DataFrame:
    return inline_table(spark, IP_LIST, ("dx", "label"))


@per_session
def part_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A score lookup with one diagnosis per part, in exact quarters and eighths."""
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        key.cast("string").alias("dx"),
        ((key % 5) / 8).alias("ednp"),
        ((key % 3) / 8).alias("pct"),
        ((key % 2) / 4).alias("nonemergent"),
    )


@per_session
def wide_enrolment(spark: SparkSession, folder: str) -> DataFrame:
    """Eligibility rows with twelve columns per measure: one row per order.

    A row fills the month of its order date, so a member has several rows that
    the panel operator must combine.
    """
    month, key = F.month("o_orderdate"), F.col("o_orderkey")
    measures = {
        "MDCD_ENRLMT_DAYS": (key % 4 * 10).cast("int"),
        "CHIP_ENRLMT_DAYS": (key % 3 * 5).cast("int"),
        "MC_PLAN_TYPE_CD": F.lpad((key % 23).cast("string"), 2, "0"),
        "CHIP_CD": (key % 6).cast("string"),
        "DUAL_ELGBL_CD": F.lpad((key % 12).cast("string"), 2, "0"),
    }
    monthly = [
        F.when(month == m, value).alias(f"{name}_{m:02d}")
        for name, value in measures.items()
        for m in range(1, 13)
    ]
    states = members(spark, folder).select("beneID", F.col("state").alias("STATE_CD"))
    return (
        table(spark, folder, "orders")
        .withColumn("beneID", F.col("o_custkey"))
        .join(states, "beneID")
        .select(F.col("beneID").alias("BENE_ID"), "STATE_CD", *monthly)
    )


@per_session
def raw_demographics(spark: SparkSession, folder: str) -> DataFrame:
    """Coded demographics of customers, each code list cycling with the key and some codes NULL."""
    key = F.col("c_custkey")

    def code(divisor: int, width: int, modulus: int):
        text = F.lpad((F.floor(key / divisor) % modulus).cast("string"), width, "0")
        return F.when(key % 13 != divisor % 13, text)

    flags = {
        f"DSBLTY_{name}_IND": F.when(key % 11 != i, (F.floor(key / (i + 2)) % (i + 3) == 0).cast("double"))
        for i, name in enumerate(
            ("DEAF", "BLND", "DFCLTY_CNCNTRTNG", "DFCLTY_WLKG", "DFCLTY_DRSNG_BATHNG",
             "DFCLTY_ERNDS", "OTHR")
        )
    }
    out = {
        "BENE_ID": key,
        "STATE_CD": F.col("c_nationkey").cast("string"),
        "BENE_STATE_CD": F.lpad(F.col("c_nationkey").cast("string"), 2, "0"),
        "BENE_CNTY_CD": F.when(key % 7 != 0, _mapped("c_mktsegment", SEGMENT_COUNTY, OTHER_COUNTY)),
        "BENE_ZIP_CD": F.lpad((key % 997).cast("string"), 5, "0"),
        "AGE": F.when(key % 17 != 0, (key % 80).cast("int")),
        "DEATH_IND": code(2, 1, 3),
        "SEX_CD": F.when(key % 3 == 0, "M").when(key % 3 == 1, "F"),
        "RACE_ETHNCTY_CD": code(3, 1, 9),
        "ENGLSH_LANG_PRFCNCY_CD": code(4, 1, 5),
        "MRTL_STUS_CD": code(5, 2, 16),
        "HSEHLD_SIZE_CD": code(6, 2, 10),
        "INCM_CD": code(7, 2, 10),
        "CTZNSHP_IND": code(8, 1, 3),
        "SSDI_IND": code(9, 1, 3),
        "SSI_IND": code(10, 1, 3),
        "TANF_CASH_CD": code(11, 1, 4),
        **flags,
    }
    return table(spark, folder, "customer").select(*[c.alias(n) for n, c in out.items()])


# --- the same views in SQL, for the check ------------------------------------

VIEWS = """
v_member as (
  select c_custkey as member_id, n_name as state, r_name as region,
         concat(lpad(cast(c_nationkey as varchar), 2, '0'),
                case c_mktsegment when 'AUTOMOBILE' then '001' when 'BUILDING' then '003'
                     when 'FURNITURE' then '005' when 'HOUSEHOLD' then '007' else '009' end) as fips_code,
         cast(c_custkey % 80 as int) as age,
         cast(1 + c_custkey % 12 as int) as member_months
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
v_header as (
  select o_custkey as member_id, o_orderkey as claim_id,
         case o_orderstatus when 'F' then '1' when 'O' then '3' else '2' end as claim_type,
         o_orderpriority as dx, cast(o_totalprice as decimal(18,2)) as header_paid,
         cast(o_orderdate as date) as claim_date
  from orders),
v_line as (
  select l_orderkey as claim_id, l_linenumber as line_num, l_linestatus as file_code,
         l_returnflag as rev_code, cast(l_linenumber as varchar) as place_code, p_type as proc_code,
         cast(l_extendedprice as decimal(18,2)) as line_equiv,
         cast(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(18,4)) as line_paid,
         cast(l_shipdate as date) as start_date,
         cast(l_shipdate as date) + cast(l_quantity as int) as end_date
  from lineitem join part on l_partkey = p_partkey),
v_claim as (
  select h.member_id, h.claim_id, h.claim_type, h.dx, h.header_paid, l.line_num, l.file_code, l.rev_code,
         l.place_code, l.proc_code, l.line_equiv, l.line_paid, l.start_date, l.end_date
  from v_line l join v_header h on l.claim_id = h.claim_id where h.claim_type in ('1', '3')),
v_event as (
  select member_id, claim_id, dx, start_date, end_date, 1 as ip, 0 as ed from v_claim where file_code = 'F'
  union all
  select member_id, claim_id, dx, start_date, end_date, 0 as ip, 1 as ed from v_claim
  where file_code = 'O' and (rev_code = 'R' or place_code in ('7') or proc_code in ('PROMO', 'ECONOMY'))),
v_ed_score as (
  select * from (values ('1-URGENT', 0.05, 0.10, 0.05), ('2-HIGH', 0.20, 0.20, 0.20),
                        ('3-MEDIUM', 0.30, 0.25, 0.20), ('5-LOW', 0.40, 0.30, 0.30))
           as t(dx, ednp, pct, nonemergent)),
v_ip_list as (
  select * from (values ('3-MEDIUM', 'a'), ('4-NOT SPECIFIED', 'b')) as t(dx, label)),
v_flagged as (
  select e.*, e.ed as all_ed, e.ip as all_ip,
         case when e.ed = 1 and s.dx is not null then 1 else 0 end as avoid_ed_visit,
         case when e.ed = 1 and s.dx is null then 1 else 0 end as other_ed_visit,
         case when e.ip = 1 and l.dx is not null then 1 else 0 end as avoid_ip_visit,
         case when e.ip = 1 and l.dx is null then 1 else 0 end as other_ip_visit
  from v_event e
  left join (select dx from v_ed_score where ednp + pct + nonemergent > 0.5) s on e.dx = s.dx
  left join v_ip_list l on e.dx = l.dx),
v_lagged as (
  select *, lag(end_date) over w as prev_end, lag(start_date) over w as prev_start,
         row_number() over w as seq
  from v_flagged window w as (partition by member_id order by start_date, end_date)),
v_numbered as (
  select *, sum(case when prev_end is null or start_date > prev_end + 1 then 1 else 0 end)
              over (partition by member_id order by start_date, end_date
                    rows between unbounded preceding and current row) as episode
  from v_lagged),
v_episode as (
  select member_id, cast(episode as bigint) as episode, max(all_ed) as all_ed, max(avoid_ed_visit) as avoid_ed_visit,
         max(other_ed_visit) as other_ed_visit, max(all_ip) as all_ip, max(avoid_ip_visit) as avoid_ip_visit,
         max(other_ip_visit) as other_ip_visit, min(start_date) as start_date, max(end_date) as end_date,
         max(dx) as dx,
         max(case when avoid_ip_visit = 1 then dx end) as ip_dx,
         max(case when avoid_ed_visit = 1 then dx end) as ed_dx
  from v_numbered group by member_id, episode),
v_class as (
  select e.*, m.state, m.fips_code,
         case when other_ip_visit = 1 then 1 else 0 end as non_avoid_ip,
         case when other_ip_visit = 0 and avoid_ip_visit = 1 then 1 else 0 end as avoid_ip,
         case when all_ip = 0 and other_ed_visit = 1 then 1 else 0 end as non_avoid_ed,
         case when all_ip = 0 and other_ed_visit = 0 and avoid_ed_visit = 1 then 1 else 0 end as avoid_ed
  from v_episode e join v_member m on e.member_id = m.member_id),
v_county as (
  select m.fips_code, m.state, total_members, member_month,
         coalesce(non_avoid_ip, 0) as non_avoid_ip, coalesce(avoid_ip, 0) as avoid_ip,
         coalesce(non_avoid_ed, 0) as non_avoid_ed, coalesce(avoid_ed, 0) as avoid_ed,
         coalesce(avoid_ip + avoid_ed, 0) as non_emergent_acute,
         coalesce(non_avoid_ip + non_avoid_ed, 0) as emergent_acute,
         coalesce(avoid_ip + avoid_ed + non_avoid_ed + non_avoid_ip, 0) as all_cause_acute,
         coalesce(avoid_ip + non_avoid_ip, 0) as total_ip,
         coalesce(avoid_ed + non_avoid_ed, 0) as total_ed
  from (select fips_code, state, count(*) as total_members, cast(sum(member_months) as bigint) as member_month
        from v_member group by fips_code, state) m
  left join (select fips_code, cast(sum(non_avoid_ip) as bigint) as non_avoid_ip, cast(sum(avoid_ip) as bigint) as avoid_ip,
                    cast(sum(non_avoid_ed) as bigint) as non_avoid_ed, cast(sum(avoid_ed) as bigint) as avoid_ed
             from v_class group by fips_code) e on m.fips_code = e.fips_code)
"""


def with_views(sql: str, *extra: str) -> str:
    """SQL text over the views, with further named subqueries in between."""
    return "with " + ",\n".join([VIEWS.strip(), *extra]) + "\n" + sql
