"""Cohort filters: same rows as the exact join, few others before it, at the stated rate, above the scan."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from claimloom.operators import cohort, prefilter, relational


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def same(left, right) -> None:
    assert left.columns == right.columns
    key = lambda row: tuple(map(str, row))  # noqa: E731  (rows may hold nulls)
    assert sorted(map(tuple, left.collect()), key=key) == sorted(map(tuple, right.collect()), key=key)


@pytest.mark.parametrize("rate", [0.1, 0.01, 0.001])
def test_other_keys_pass_at_the_stated_rate(spark, rate):
    members = spark.range(0, 300_000, 3).selectExpr("id member", "cast(id % 50 as string) state")
    claims = spark.range(300_000).selectExpr("id member", "cast(id % 50 as string) state")
    words = prefilter.words_for(100_000, rate)
    expected = prefilter.false_positives(100_000, words)
    assert expected <= rate < prefilter.false_positives(100_000, words // 2)
    passed = claims.where(prefilter.may_be_member(members, ["member", "state"], rate))
    counts = passed.agg(F.count_if(F.expr("member % 3 = 0")), F.count_if(F.expr("member % 3 != 0"))).first()
    assert counts[0] == 100_000
    assert abs(counts[1] - 200_000 * expected) <= 6 * (200_000 * expected) ** 0.5 + 1


def test_hard_rows(rows):
    claims = rows(
        [(1, "ME", 10), (1, "VT", 11), (2, "ME", 12), (2, "ME", 12), (None, "ME", 13), (3, None, 14), (None, None, 15), (9, "", 16)],
        "member long, state string, claim int",
    )
    members = rows(
        [(1, "ME", "a"), (2, "ME", "b"), (None, "ME", "c"), (3, None, "d"), (9, "", "e"), (7, "ME", "f")], "member long, state string, county string"
    )
    for carry in ([], ["county"]):
        same(
            prefilter.restrict_early(claims, members, ["member", "state"], carry),
            relational.restrict(claims, members, ["member", "state"], carry),
        )
    twice = members.unionByName(members)
    same(prefilter.restrict_early(claims, twice, ["member", "state"]), relational.restrict(claims, members, ["member", "state"]))
    assert prefilter.restrict_early(claims, members.limit(0), ["member", "state"]).count() == 0
    assert prefilter.restrict_early(claims.limit(0), members, ["member", "state"]).count() == 0
    other = claims.selectExpr("cast(member as int) member", "state", "claim")  # another type: the exact join alone
    assert prefilter.restrict_early(other, members, ["member", "state"]).count() == 4
    dated = rows([("2024-01-01", 1), ("2024-01-02", 2)], "day date, n int")
    assert [tuple(r) for r in prefilter.restrict_early(dated, dated.where("n = 2"), "day").collect()] == [(date(2024, 1, 2), 2)]


def test_a_cohort_too_large_for_the_filter_is_joined_exactly(spark, monkeypatch):
    monkeypatch.setattr(prefilter, "MAX_WORDS", 8)
    members, claims = spark.range(1000).toDF("member"), spark.range(500, 2000).toDF("member")
    assert prefilter.may_be_member(members, "member", 0.01) is None
    assert prefilter.restrict_early(claims, members, "member").count() == 500


def test_rows_go_before_the_shuffle(spark, tmp_path):
    spark.range(20_000).selectExpr("id % 5000 beneID", "'ME' state", "id claim").write.parquet(f"{tmp_path}/claims")
    claims = spark.read.parquet(f"{tmp_path}/claims")
    spark.range(0, 5000, 50).selectExpr("id beneID", "'ME' state").write.parquet(f"{tmp_path}/members")
    sample = spark.read.parquet(f"{tmp_path}/members")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        scoped = cohort.scoped_claims(claims, sample, ["ME"], false_positives=0.01)
        same(scoped, cohort.scoped_claims(claims, sample, ["ME"]))
        text = plan(scoped)
        assert "EqualTo(state,ME)" in text
        tree = text.split("\n\n")[0]
        # read from the join downwards: the claims' exchange stands above the filter with the subquery
        assert tree.index("SortMergeJoin") < tree.index("Exchange") < tree.index("Filter") < tree.index("Scan parquet")
        assert "bit_or" in text
        passed = claims.where(prefilter.may_be_member(sample, ["beneID", "state"], 0.01)).count()
        assert 400 <= passed <= 400 + 3 * 0.01 * 19_600
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
