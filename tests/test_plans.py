"""The shape of the physical plans: what reaches the scan, what moves, what must not appear."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from claimloom.operators import claims, classify, cohort, episodes, rates, relational
from claimloom.plans.catalogue import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Claim lines, headers and members as files, so that scans show what is pushed down."""
    folder = tmp_path_factory.mktemp("claims")
    spark.range(1000).selectExpr(
        "id % 50 BENE_ID", "'ME' STATE_CD", "id % 100 CLM_ID", "id LINE_NUM", "'0450' REV_CNTR_CD", "'x' unused"
    ).write.parquet(f"{folder}/lines")
    spark.range(100).selectExpr(
        "id % 50 BENE_ID", "'ME' STATE_CD", "id CLM_ID", "cast(id % 5 as string) CLM_TYPE_CD",
        "date'2024-01-01' + cast(id as int) SRVC_BGN_DT", "date'2024-01-03' + cast(id as int) SRVC_END_DT", "'y' unused_too"
    ).write.parquet(f"{folder}/headers")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("lines", "headers")}


def test_filters_and_columns_reach_the_scan(stored):
    df = claims.assemble_claims(stored["lines"], stored["headers"]).select("BENE_ID", "LINE_NUM", "SRVC_BGN_DT")
    text = plan(df)
    assert "In(CLM_TYPE_CD, [1,3])" in text
    assert "IsNotNull(BENE_ID)" in text and "IsNotNull(STATE_CD)" in text
    schemas = re.findall(r"ReadSchema: (.*)", text)
    assert schemas and not any("unused" in s or "REV_CNTR_CD" in s for s in schemas)


def test_stored_buckets_are_joined_in_place(spark, stored, tmp_path):
    """Second and later assemblies, and claim-level aggregates, start from the files without an exchange."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        lines, headers = claims.bucketed_claims(stored["lines"], stored["headers"], "bucketed", 4, folder=str(tmp_path))
        joined = claims.assemble_claims(lines, headers)
        flags = claims.claim_flags(claims.presence_flags(joined, {"dated": "SRVC_BGN_DT"}), ["dated"])
        assert "Exchange" not in plan(joined) and "Exchange" not in plan(flags) and "SortMergeJoin" in plan(joined)
        same = claims.assemble_claims(stored["lines"], stored["headers"])
        assert sorted(map(tuple, joined.select(*same.columns).collect())) == sorted(map(tuple, same.collect()))
        assert flags.count() == same.select("BENE_ID", "STATE_CD", "CLM_ID").distinct().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("bucketed_line", "bucketed_header"):
            spark.sql(f"drop table if exists {name}")


def test_state_scope_reaches_both_sides(stored):
    lines = stored["lines"].withColumnsRenamed({"BENE_ID": "beneID", "STATE_CD": "state"})
    sample = stored["headers"].withColumnsRenamed({"BENE_ID": "beneID", "STATE_CD": "state"})
    text = plan(cohort.scoped_claims(lines, sample, ["ME", "VA"]))
    assert text.count("In(STATE_CD, [ME,VA])") >= 2


def test_episode_collapse_orders_intervals_not_events(stored):
    events = stored["headers"].selectExpr(
        "BENE_ID beneID", "STATE_CD state", "SRVC_BGN_DT StartDate", "SRVC_END_DT EndDate", "1 flag"
    )
    text = plan(episodes.collapse_episodes(events, ["flag"]))
    tree = text.split("\n\n")[0]
    first_window = tree.index("Window")
    assert "HashAggregate" in tree[first_window:], "events are aggregated below the window"
    aggregates = optimized(episodes.collapse_episodes(events, ["flag"]))
    assert "localCheckpoint" not in aggregates


def test_episode_collapse_is_one_ordered_pass(stored):
    """One sort, two windows over it, and one read of the events."""
    events = stored["headers"].selectExpr(
        "BENE_ID beneID", "STATE_CD state", "SRVC_BGN_DT StartDate", "SRVC_END_DT EndDate", "1 flag"
    )
    tree = plan(episodes.collapse_episodes(events, ["flag"])).split("\n\n")[0]
    assert "Union" not in tree
    counts = [len(re.findall(rf"(?:- |\* ){name} \(", tree)) for name in ("Sort", "Window", "Scan parquet ")]
    assert counts == [1, 2, 1]


def test_episode_numbers_move_rows_once(stored):
    """Rows with a usable end go through one exchange and no sort or window: only day summaries are ordered."""
    events = stored["headers"].selectExpr(
        "BENE_ID beneID", "STATE_CD state", "SRVC_BGN_DT StartDate", "SRVC_END_DT EndDate", "CLM_ID"
    )
    linked = plan(episodes.number_episodes(events, overlap=None)).split("\n\n")[0]
    linked = linked[linked.index("ShuffledHashJoin"):]
    left = linked[: linked.index("Scan parquet")]
    assert left.count("Exchange") == 1 and "Sort " not in left and "Window" not in left


def test_hot_keys_shrink_before_the_shuffle(stored):
    """Grouping operators aggregate on the map side before their exchange."""
    tree = plan(relational.exclusive(stored["lines"], "CLM_ID")).split("\n\n")[0]
    below = tree[tree.index("Exchange"):]
    assert "Aggregate" in below
    assert "Join" not in tree


def test_row_total_is_no_single_task_window(stored):
    tree = plan(rates.describe_categories(stored["lines"], ["STATE_CD"])).split("\n\n")[0]
    assert "Window" not in tree and "SinglePartition" not in tree.split("Subqueries")[0]


def test_lookup_broadcast_is_sized_by_spark(spark, stored):
    events = stored["headers"].withColumnRenamed("CLM_TYPE_CD", "dx")
    lookup = stored["lines"].selectExpr("cast(LINE_NUM as string) dx").distinct().withColumn("hit", F.lit(1))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "BroadcastHashJoin" not in plan(classify.lookup_flag(events, lookup, "dx", "hit"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_multiplies_or_leaves_the_engine(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert word not in text
