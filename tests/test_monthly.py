"""Months are replaced one at a time; a load that fails leaves the table as it was."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from claimloom.sources import monthly


@pytest.fixture
def table(spark, tmp_path):
    spark.sql("drop table if exists monthly_claims")
    first = spark.range(10).selectExpr("id claim", "'a' state")
    monthly.create(spark, "monthly_claims", first.schema, str(tmp_path))
    for month in ("01", "02"):
        monthly.load_month(first, "monthly_claims", month, str(tmp_path))
    yield str(tmp_path)
    spark.sql("drop table if exists monthly_claims")


def counts(spark):
    return {(r.month, r.state): r["count"] for r in spark.table("monthly_claims").groupBy("month", "state").count().collect()}


def test_a_reload_changes_its_month_only(spark, table):
    assert counts(spark) == {("01", "a"): 10, ("02", "a"): 10}
    files = set(spark.table("monthly_claims").where("month = '01'").inputFiles())
    monthly.load_month(spark.range(4).selectExpr("'b' state", "id claim"), "monthly_claims", "02", table)
    assert counts(spark) == {("01", "a"): 10, ("02", "b"): 4}
    assert set(spark.table("monthly_claims").where("month = '01'").inputFiles()) == files
    monthly.load_month(spark.range(3).selectExpr("id claim", "'c' state"), "monthly_claims", "03", table)
    monthly.load_month(spark.range(0).selectExpr("id claim", "'c' state"), "monthly_claims", "02", table)
    assert counts(spark) == {("01", "a"): 10, ("03", "c"): 3}


def test_a_failed_load_leaves_the_old_rows(spark, table):
    broken = spark.range(100).selectExpr("if(id < 99, id, cast(raise_error('lost') as bigint)) claim", "'x' state")
    for month in ("01", "04"):
        with pytest.raises(Exception, match="lost"):
            monthly.load_month(broken, "monthly_claims", month, table)
    assert counts(spark) == {("01", "a"): 10, ("02", "a"): 10}


def test_other_columns_are_refused(spark, table):
    good = spark.range(1).selectExpr("id claim", "'a' state")
    for bad in (good.drop("state"), good.withColumn("month", F.lit("02")), good.withColumn("claim", F.lit("1"))):
        with pytest.raises(ValueError):
            monthly.load_month(bad, "monthly_claims", "01", table)
    assert counts(spark) == {("01", "a"): 10, ("02", "a"): 10}


def test_a_month_is_read_alone(spark, table):
    one = spark.table("monthly_claims").where("month = '02'")
    assert one.count() == 10 and all("/loads/" in f for f in one.inputFiles()) and len(one.inputFiles()) < len(spark.table("monthly_claims").inputFiles())


def test_months_loaded_together(spark, table):
    rows = spark.range(30).selectExpr("id claim", "lpad(cast(2 + id % 3 as string), 2, '0') month", "'d' state")
    monthly.load_months(rows, "monthly_claims", table)
    assert counts(spark) == {("01", "a"): 10, ("02", "d"): 10, ("03", "d"): 10, ("04", "d"): 10}
    monthly.load_months(rows.where("claim < 0"), "monthly_claims", table)
    with pytest.raises(Exception, match="no usable month"):
        monthly.load_months(rows.withColumn("month", F.when(F.col("claim") != 7, F.col("month"))), "monthly_claims", table)
    assert counts(spark) == {("01", "a"): 10, ("02", "d"): 10, ("03", "d"): 10, ("04", "d"): 10}
