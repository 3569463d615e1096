"""Scans, filters, joins, aggregates and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.columns import county_key, state_prefix, total
from ...operators import audit, rates, relational, variation
from ...sources import readers, writers
from .. import testbed
from ..testbed import table, with_views
from .registry import query


@query(
    "scan_project",
    """select l_orderkey as claim_id, l_linenumber as line_num, cast(l_shipdate as date) as start_date,
              cast(l_quantity as int) as units, 1 as present
       from lineitem""",
)
def scan_project(spark, folder):
    item = table(spark, folder, "lineitem").withColumnsRenamed(
        {"l_orderkey": "claim_id", "l_linenumber": "line_num"}
    )
    item.createOrReplaceTempView("claim_lines")
    return (
        readers.scan(spark, "claim_lines", ["claim_id", "line_num", "l_shipdate", "l_quantity"], ["claim_id"])
        .withColumns(
            {
                "start_date": F.col("l_shipdate").cast("date"),
                "units": F.col("l_quantity").cast("int"),
                "present": F.lit(1),
            }
        )
        .drop("l_shipdate", "l_quantity")
    )


@query(
    "union_family",
    """select lpad(cast(month(o_orderdate) as varchar), 2, '0') as month, o_orderkey as claim_id, o_custkey as member_id
       from orders""",
)
def union_family(spark, folder):
    orders = table(spark, folder, "orders")
    family = {
        m: orders.where(F.month("o_orderdate") == int(m)).select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("member_id"))
        for m in readers.MONTHS
    }
    return readers.month_family(family).select("month", "claim_id", "member_id")


@query(
    "csv_lookup",
    """select cast(p_partkey as varchar) as "diagnosisOne", p_type as "ccsrCatOne" from part""",
)
def csv_lookup(spark, folder):
    part = table(spark, folder, "part").select(
        F.concat(F.lit("'"), F.col("p_partkey").cast("string"), F.lit("'")).alias("diagnosisOne"),
        F.concat(F.lit("'"), F.col("p_type"), F.lit("'")).alias("ccsrCatOne"),
    )
    path = writers.shared_folder(spark, "lookup")
    writers.save_csv(part, path)
    return readers.read_lookup(spark, path, readers.CATEGORY_SCHEMA, strip="'")


@query(
    "write_table",
    """select p_brand, p_partkey, p_size, p_retailprice from part""",
)
def write_table(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    path = writers.shared_folder(spark, "table")
    # one catalog entry under a fixed name, whatever the number of runs
    spark.sql("drop table if exists written_parts")
    saved = writers.save_table(part, "written_parts", partition_by=["p_brand"], path=path)
    return saved.select("p_brand", "p_partkey", "p_size", "p_retailprice")


@query(
    "crosswalk",
    """select c_custkey as member_id, lpad(cast(c_nationkey as varchar), 2, '0') as fips_state,
              case c_nationkey when 1 then 'AL' when 2 then 'AK' when 4 then 'AZ' when 5 then 'AR' when 6 then 'CA'
                   when 8 then 'CO' when 9 then 'CT' when 10 then 'DE' when 11 then 'DC' when 12 then 'FL'
                   when 13 then 'GA' when 15 then 'HI' when 16 then 'ID' when 17 then 'IL' when 18 then 'IN'
                   when 19 then 'IA' when 20 then 'KS' when 21 then 'KY' when 22 then 'LA' when 23 then 'ME'
                   when 24 then 'MD' end as state_name,
              lpad(cast(c_nationkey as varchar), 2, '0') || c_mktsegment as county
       from customer""",
)
def crosswalk(spark, folder):
    located = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("member_id"),
        county_key(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), "c_mktsegment").alias("county"),
    )
    return (
        located.withColumn("fips_state", state_prefix("county"))
        .join(readers.fips_to_state(spark), "fips_state", "left")
        .select("member_id", "fips_state", "state_name", "county")
    )


@query(
    "derived_measures",
    """select o_orderkey as claim_id, o_totalprice * 2 as price_double, cast(o_orderkey as double) * 2 as key_double,
              o_totalprice + cast(o_orderkey as double) as both, o_totalprice / 12 as monthly
       from orders""",
)
def derived_measures(spark, folder):
    measures = {"price": "o_totalprice", "key": "o_orderkey"}
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("claim_id"),
        *[F.col(c).cast("double").alias(n) for n, c in measures.items()],
    )
    return orders.select(
        "claim_id",
        *[F.expr(f"{n} * 2").alias(f"{n}_double") for n in measures],
        total(measures).alias("both"),
        (F.col("price") / 12).alias("monthly"),
    )


@query(
    "filter_in",
    """select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F' or o_orderstatus = 'O'""",
)
def filter_in(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.where(F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_orderstatus")


@query(
    "filter_not_in",
    """select o_orderkey, o_orderpriority from orders where o_orderpriority not in ('1-URGENT', '5-LOW')""",
)
def filter_not_in(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.where(~F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select(
        "o_orderkey", "o_orderpriority"
    )


@query(
    "filter_range",
    """select l_orderkey, l_quantity, l_linestatus from lineitem
       where l_quantity >= 10 and l_quantity < 40 and l_linestatus <> 'O' and l_discount = 0.05""",
)
def filter_range(spark, folder):
    item = table(spark, folder, "lineitem")
    wanted = (
        (F.col("l_quantity") >= 10) & (F.col("l_quantity") < 40)
        & (F.col("l_linestatus") != "O") & (F.col("l_discount") == 0.05)
    )
    return item.where(wanted).select("l_orderkey", "l_quantity", "l_linestatus")


@query(
    "filter_null",
    """select c_custkey, nullif(c_mktsegment, 'BUILDING') as segment, case when c_acctbal > 0 then c_acctbal end as balance
       from customer where c_mktsegment <> 'BUILDING' and c_acctbal > 0""",
)
def filter_null(spark, folder):
    customer = table(spark, folder, "customer").select(
        "c_custkey",
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"),
    )
    return customer.dropna(subset=["segment"]).where(F.col("balance").isNotNull())


@query(
    "null_fill",
    """select c_custkey as member_id, coalesce(n, 0) as claims, coalesce(paid, 0.0) as paid
       from customer left join (
         select o_custkey, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as paid
         from orders group by o_custkey) on c_custkey = o_custkey""",
)
def null_fill(spark, folder):
    counts = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("member_id")).agg(
        F.count(F.lit(1)).alias("claims"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("paid"),
    )
    people = table(spark, folder, "customer").select(F.col("c_custkey").alias("member_id"))
    return relational.enrich(people, counts, "member_id", fill={"claims": 0, "paid": 0.0})


@query(
    "dedupe_keys",
    """select distinct l_orderkey, l_linenumber from lineitem""",
)
def dedupe_keys(spark, folder):
    item = table(spark, folder, "lineitem")
    return item.dropDuplicates(["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query(
    "distinct_rows",
    """select distinct l_returnflag, l_linestatus, l_linenumber, l_suppkey from lineitem""",
)
def distinct_rows(spark, folder):
    item = table(spark, folder, "lineitem")
    return item.select("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey").dropDuplicates()


@query(
    "exclusive_keys",
    """select l_orderkey, l_linenumber, l_partkey, l_shipdate, l_returnflag from lineitem
       qualify count(*) over (partition by l_orderkey, l_linenumber) = 1""",
)
def exclusive_keys(spark, folder):
    item = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_returnflag"
    )
    return relational.exclusive(item, ["l_orderkey", "l_linenumber"])


@query(
    "inner_join",
    with_views("select claim_id, line_num, claim_type, line_paid from v_line join v_header using (claim_id)"),
)
def inner_join(spark, folder):
    lines = testbed.lines(spark, folder, False)
    return (
        lines.join(testbed.headers(spark, folder), "CLM_ID", "inner")
        .select(
            F.col("CLM_ID").alias("claim_id"), F.col("LINE_NUM").alias("line_num"),
            F.col("CLM_TYPE_CD").alias("claim_type"), "line_paid",
        )
    )


@query(
    "left_join",
    """select c_custkey as member_id, o_orderkey as claim_id from customer
       left join orders on c_custkey = case when o_custkey % 5 = 0 then -o_custkey else o_custkey end""",
)
def left_join(spark, folder):
    # every fifth customer's orders carry a key that does not exist
    key = F.when(F.col("o_custkey") % 5 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    orders = table(spark, folder, "orders").select(key.alias("member_id"), F.col("o_orderkey").alias("claim_id"))
    people = table(spark, folder, "customer").select(F.col("c_custkey").alias("member_id"))
    return relational.enrich(people, orders, "member_id")


@query(
    "semi_restrict",
    """select o_orderkey, o_custkey from orders
       where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')""",
)
def semi_restrict(spark, folder):
    people = table(spark, folder, "customer").where(F.col("c_mktsegment") == "BUILDING")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return relational.restrict(orders, people.select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select(
        "o_orderkey", "o_custkey"
    )


@query(
    "attach_cohort",
    with_views(
        """select h.member_id, h.claim_id, m.state, m.fips_code, m.member_months
           from v_header h join v_member m on h.member_id = m.member_id where m.age < 65"""
    ),
)
def attach_cohort(spark, folder):
    cohort = testbed.members(spark, folder).where(F.col("age") < 65)
    claims = testbed.headers(spark, folder).select("beneID", "CLM_ID")
    return relational.restrict(claims, cohort, "beneID", ["state", "fips_code", "medicaidMonths"]).select(
        F.col("beneID").alias("member_id"), F.col("CLM_ID").alias("claim_id"), "state", "fips_code",
        F.col("medicaidMonths").alias("member_months"),
    )


@query(
    "freq_table",
    """select o_orderpriority, count(*) as "count" from orders group by o_orderpriority""",
)
def freq_table(spark, folder):
    return rates.frequencies(table(spark, folder, "orders"), "o_orderpriority", ordered=True)


@query(
    "first_rows",
    """select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100""",
)
def first_rows(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query(
    "cross_freq",
    """select l_returnflag, l_linestatus, l_linenumber, count(*) as "count" from lineitem
       group by l_returnflag, l_linestatus, l_linenumber""",
)
def cross_freq(spark, folder):
    return rates.frequencies(
        table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]
    )


@query(
    "distinct_count",
    """select count(distinct l_orderkey) as claims, count(distinct l_suppkey) as providers,
              count(distinct l_partkey) as procedures from lineitem""",
)
def distinct_count(spark, folder):
    item = table(spark, folder, "lineitem")
    return item.agg(
        F.countDistinct("l_orderkey").alias("claims"),
        F.countDistinct("l_suppkey").alias("providers"),
        F.countDistinct("l_partkey").alias("procedures"),
    )


@query(
    "global_sum",
    """select cast(sum(cast(l_quantity as bigint)) as bigint) as units, count(l_orderkey) as lines,
              cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as price from lineitem""",
)
def global_sum(spark, folder):
    item = table(spark, folder, "lineitem")
    return item.agg(
        F.sum(F.col("l_quantity").cast("long")).alias("units"),
        F.count("l_orderkey").alias("lines"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price"),
    )


@query(
    "summary_stats",
    """select count(o_totalprice) as "count", round(avg(o_totalprice), 4) as mean,
              round(stddev_samp(o_totalprice), 4) as stddev, min(o_totalprice) as "min", max(o_totalprice) as "max"
       from orders""",
)
def summary_stats(spark, folder):
    out = variation.describe(table(spark, folder, "orders"), "o_totalprice")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "stddev")})


@query(
    "missingness_census",
    """with coded as (
         select case when c_custkey % 7 = 0 then null else c_mktsegment end as segment,
                case c_custkey % 9 when 0 then '' when 1 then 'None' when 2 then 'is NULL' else c_name end as label,
                case when c_custkey % 5 = 0 then cast('nan' as double) when c_custkey % 5 = 1 then null else c_acctbal end as balance,
                c_nationkey as nation
         from customer)
       select 'segment' as "column", count(*) filter (segment is null) as missing from coded
       union all select 'label', count(*) filter (label is null or label = '' or contains(label, 'None') or contains(label, 'NULL')) from coded
       union all select 'balance', count(*) filter (balance is null or isnan(balance)) from coded
       union all select 'nation', count(*) filter (nation is null) from coded""",
)
def missingness_census(spark, folder):
    key = F.col("c_custkey")
    coded = table(spark, folder, "customer").select(
        F.when(key % 7 != 0, F.col("c_mktsegment")).alias("segment"),
        F.when(key % 9 == 0, "").when(key % 9 == 1, "None").when(key % 9 == 2, "is NULL")
        .otherwise(F.col("c_name")).alias("label"),
        F.when(key % 5 == 0, float("nan")).when(key % 5 != 1, F.col("c_acctbal")).alias("balance"),
        F.col("c_nationkey").alias("nation"),
    )
    return audit.missingness(coded)


@query("coverage", with_views('select state, count(*) as "count" from v_header h join v_member m on h.member_id = m.member_id group by state'))
def coverage(spark, folder):
    people = testbed.members(spark, folder).select("beneID", "state")
    claims = testbed.headers(spark, folder).select("beneID")
    return audit.coverage(relational.restrict(claims, people, "beneID", ["state"]))
