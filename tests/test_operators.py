"""Edge rows of the domain operators: missing values, ties, zero denominators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimloom.functions import codes
from claimloom.functions.columns import (
    any_all_flag, bands, census_region, ed_visit, enrolment_status, flag, is_missing, recode, share,
)
from claimloom.operators import (
    adjust, audit, claims, classify, cohort, cost, geography, panel, rates, relational, variation,
)
from claimloom.sources import readers, writers


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def test_enrolment_status(rows):
    df = rows([(31,), (0,), (None,)], "days int")
    assert values(df.select(enrolment_status("days").alias("s")), "s") == ["yes", "no", "missing"]


def panel_rows(rows, days, chip, dual="00", plan=None, code="1"):
    df = rows(
        [(1, "ME", "1", days, chip, plan, code, dual)],
        "beneID int,state string,month string,medicaidDays int,chipDays int,mcPlanType string,chipCode string,dualStatus string",
    )
    return df


def test_chip_only_months_do_not_count_by_default(rows):
    df = panel_rows(rows, 0, 31)
    assert values(panel.enrolment_labels(df), "enrolled") == ["no"]
    assert values(panel.enrolment_labels(df, count_chip=True), "enrolled") == ["yes"]
    assert panel.covered_months(panel.enrolment_labels(df)).count() == 0


@pytest.mark.parametrize("code,label", [("00", "no"), ("02", "yes"), (None, "missing"), ("99", "missing")])
def test_dual_recode(rows, code, label):
    assert values(panel.enrolment_labels(panel_rows(rows, 1, 0, dual=code)), "dual") == [label]


@pytest.mark.parametrize("code,label", [("01", "yes"), ("00", "no"), (None, "no")])
def test_managed_care_recode(rows, code, label):
    assert values(panel.enrolment_labels(panel_rows(rows, 1, 0, plan=code)), "managedCare") == [label]


def test_age_bands(rows):
    df = rows([(9.0,), (9.5,), (10.0,), (17.9,), (18.0,), (64.5,), (65.0,), (None,)], "age double")
    assert values(df.select(bands("age").alias("b")), "b") == [
        "under10", "under10", "10To17", "10To17", "18To29", "50To64", "over64", "missing",
    ]


def test_disability(rows):
    names = [f"f{i}" for i in range(7)]
    df = rows(
        [(1.0, *[None] * 6), (0.0,) * 7, (0.0,) * 6 + (None,)], ",".join(f"{n} double" for n in names)
    )
    assert values(df.select(any_all_flag(names).alias("d")), "d") == ["yes", "no", "missing"]


def test_numeric_codes_match_padded_text(rows):
    df = rows([("1",), ("01",), ("x",), (None,), ("2",)], "code string")
    assert values(df.select(recode("code", {"hit": (1,)}).alias("r")), "r") == [
        "hit", "hit", "missing", "missing", "missing",
    ]


def test_recode_tables_are_disjoint():
    for _, labels in codes.DEMOGRAPHIC_RECODES.values():
        used = [c for values in labels.values() for c in values]
        assert len(used) == len(set(used))
    states = [s for region in codes.CENSUS_REGIONS.values() for s in region]
    assert len(states) == len(set(states))


def test_census_region(rows):
    df = rows([("IA",), ("AK",), ("ME",), ("VA",)], "state string")
    assert values(df.select(census_region("state").alias("r")), "r") == ["Midwest", "West", "Northeast", "South"]
    assert values(df.select(census_region("state", legacy=True).alias("r")), "r")[:2] == ["South", "South"]


def test_exclusive_drops_every_row_of_a_repeated_key(rows):
    df = rows([(1, "A"), (1, "B"), (2, "A"), (None, "C")], "k int,state string")
    assert values(relational.exclusive(df, "k"), "k", "state") == [(2, "A")]


def test_eligible(rows):
    df = rows([(1, 0, 30), (2, 1, 30), (3, 0, 65), (4, 0, None), (5, None, 20)], "id int,medicareMonths int,age int")
    assert values(cohort.eligible(df), "id") == [1]


def test_ed_detector(rows):
    df = rows(
        [(None, None, None), (None, "23", None), (None, "1A", None), ("0450", None, None), (None, None, "99285")],
        "REV_CNTR_CD string,POS_CD string,LINE_PRCDR_CD string",
    )
    assert values(df.select(flag(ed_visit()).alias("v")), "v") == [0, 1, 0, 1, 1]


def test_score_threshold_and_repeated_codes(rows):
    df = rows(
        [("a", 0.25, 0.25, 0.0), ("b", 0.25, 0.26, 0.0), ("c", 0.1, 0.1, 0.1), ("c", 0.5, 0.5, 0.0), ("d", None, 0.9, 0.0)],
        "dx string,ednp double,pct double,nonemergent double",
    )
    assert dict(values(classify.score_avoidable(df), "dx", "avoidableEdVisit")) == {"a": 0, "b": 1, "c": 1, "d": 0}
    counts = classify.threshold_counts(df).first()
    assert counts.above_0 >= counts.above_0_5 >= counts.above_0_75 >= counts.above_0_9 >= counts.certain


def test_lookup_miss_is_zero(rows):
    events = rows([(1, "a"), (2, "z"), (3, None)], "id int,dx string")
    lookup = rows([("a", 1)], "dx string,hit int")
    out = classify.lookup_flag(events, lookup, "dx", "hit")
    assert dict(values(out, "id", "hit")) == {1: 1, 2: 0, 3: 0}
    listed = rows([("a",), ("a",)], "dx string")
    assert dict(values(classify.lookup_member(events, listed, "dx", "hit"), "id", "hit")) == {1: 1, 2: 0, 3: 0}


def test_prefix_lookup_takes_the_larger_flag(rows):
    events = rows([(1, "J450"), (2, "J45"), (3, "K10")], "id int,dx string")
    lookup = rows([("J450", 0), ("J45", 1)], "dx string,hit int")
    out = classify.lookup_with_prefix(events, lookup, "dx", "hit")
    assert dict(values(out, "id", "hit")) == {1: 1, 2: 1, 3: 0}


def test_hierarchy_is_exclusive(spark, rows):
    flags = classify.VISIT_FLAGS
    every = [tuple((i >> b) & 1 for b in range(4)) for i in range(1, 16)]
    data = [
        (int(ae or ne), ae, ne, int(ai or ni), ai, ni) for ae, ne, ai, ni in every
    ]
    df = rows(data, ",".join(f"{f} int" for f in flags))
    out = classify.hierarchy(classify.inpatient_over_ed(df))
    assert all(sum(r[c] for c in classify.CLASSES) == 1 for r in out.collect())
    mixed = out.where("avoidEdVisit = 1 and avoidIpVisit = 1 and nonAvoidIpVisit = 1").collect()
    assert all(r.non_avoid_ip == 1 for r in mixed)


def small_county(rows):
    members = rows([(i, "01001", 4) for i in range(3)] + [(9, "01003", 1)], "beneID int,fips_code string,medicaidMonths int")
    episodes = rows(
        [("01001", 0, 1, 0, 0), ("01001", 1, 0, 0, 0)],
        "fips_code string,non_avoid_ip int,avoid_ip int,non_avoid_ed int,avoid_ed int",
    )
    return geography.roll_up(members, episodes)


def test_county_without_events_holds_zeros(rows):
    found = {r.fips_code: r for r in small_county(rows).collect()}
    assert found["01003"].all_cause_acute == 0 and found["01003"].total_members == 1
    assert (found["01001"].member_month, found["01001"].total_ip, found["01001"].avoid_ip) == (12, 2, 1)


def test_share_of_zero_is_null(rows):
    df = rows([(0, 0), (1, 4)], "a int,b int")
    assert values(df.select(share("a", "b").alias("s")), "s") == [None, 25.0]


def test_shares_come_from_rounded_rates(rows):
    columns = "total_members int,member_month int,non_avoid_ip int,avoid_ip int,non_avoid_ed int,avoid_ed int"
    counties = geography.derived_totals(rows([(60, 700, 2, 1, 0, 0)], columns))
    out = rates.utilisation(counties).first()
    assert (out.avoid_ip, out.total_ip, out.ip_percent) == (1.4, 4.3, 32.6)
    assert out.ed_percent is None
    exact = rates.utilisation(counties, rounded=False).first()
    assert exact.ip_percent == pytest.approx(100 / 3)


def test_suppression(rows):
    df = rows([(1, 11, 12), (2, 12, 12), (3, None, 12), (4, 0, 0)], "id int,a int,b int")
    assert values(geography.suppress(df, ["a", "b"]), "id") == [2]


def cost_lines(rows, data):
    return rows(
        data,
        "beneID int,state string,fips_code string,CLM_ID int,CLM_TYPE_CD string,MDCD_PD_AMT double,LINE_MDCD_FFS_EQUIV_AMT double",
    )


def test_inpatient_cost(rows):
    encounter = cost_lines(rows, [(1, "ME", "23001", 7, "3", None, v) for v in (10.0, 20.0, None)])
    assert cost.inpatient_cost(encounter, "state").first().inpatient_cost == 10.0
    assert cost.inpatient_cost(encounter, "state", encounter_rule="sum").first().inpatient_cost == 30.0
    paid = cost_lines(rows, [(1, "ME", "23001", 8, "1", 100.0, None)] * 3)
    assert cost.inpatient_cost(paid, "state").first().inpatient_cost == 100.0


def test_one_scan_service_cost_equals_two(rows):
    data = [
        (1, "ME", "1", 5.0, 50.0, 1), (1, "ME", "3", 7.0, 70.0, 0), (2, "ME", "1", None, 1.0, 0), (3, "VA", "3", 2.0, 20.0, 0),
    ]
    lines = rows(data, "beneID int,state string,CLM_TYPE_CD string,LINE_MDCD_PD_AMT double,LINE_MDCD_FFS_EQUIV_AMT double,ed int")
    detector = F.col("ed") == 1
    two = cost.combine_costs(cost.line_cost(lines, "state"), [cost.ed_cost(lines, "state", detector)], "state")
    one = cost.service_costs(lines, "state", detector).select(two.columns)
    assert sorted(one.collect()) == sorted(two.collect())
    assert {r.state: r.total_cost_ed for r in one.collect()} == {"ME": 5.0, "VA": None}


def test_acute_cost_needs_both_parts(rows):
    df = rows([(100.0, None, 50.0, 20.0)], "inpatient_cost double,total_cost_ed double,ip_percent double,ed_percent double")
    assert cost.avoidable_cost(df).first().avoid_acute_cost is None
    assert cost.avoidable_cost(df, fill=0.0).first().avoid_acute_cost == 50.0


def test_units_with_ed_cost_only(rows):
    ip, ed = rows([("a", 1.0)], "u string,ip double"), rows([("a", 2.0), ("b", 3.0)], "u string,ed double")
    assert cost.combine_costs(ip, [ed], "u").count() == 1
    assert cost.combine_costs(ip, [ed], "u", how="full").count() == 2


def test_savings(rows):
    units = rows(
        [("x", 24, 120.0, 60.0), ("x", 24, 60.0, 60.0), ("x", 24, 10.0, 60.0)],
        "state string,member_month int,pmpy_ed double,pmpy_ip double",
    )
    out = cost.savings_to_median(units)
    assert sorted(values(out, "saving_ed")) == [0.0, 0.0, 120.0]
    assert set(values(out, "saving_ip")) == {0.0}
    total = cost.savings_summary(out, "state", with_total=True).collect()
    assert {r.state: r.saving_total for r in total} == {"x": 120.0, None: 120.0}


def test_total_row_is_told_from_a_group_of_nulls(rows):
    units = rows(
        [("x", "a", 12, 1.0, 2.0), (None, "a", 12, 4.0, 8.0)],
        "state string,county string,member_month int,saving_ed double,saving_ip double",
    )
    got = cost.savings_summary(units, ["state", "county"], with_total=True).collect()
    assert {(r.state, r.county, r.is_total, r.saving_total) for r in got} == {
        ("x", "a", False, 3.0), (None, "a", False, 12.0), (None, None, True, 15.0),
    }
    lines = rows([(1, "x", "p"), (2, None, "p"), (3, None, None)], "claim int,state string,proc string")
    got = claims.completeness(lines, {"has": "proc"}, by=["state"], keys=["claim", "state"], with_total=True).collect()
    assert {(r.state, r.is_total, r["has"], r.totalClaims) for r in got} == {("x", False, 1, 1), (None, False, 1, 2), (None, True, 2, 3)}


def test_members_without_claims_cost_nothing(rows):
    members = rows([(1, "ME", "23001"), (2, "ME", "23001")], "beneID int,state string,fips_code string")
    spend = rows([(1, "ME", 50.0)], "beneID int,state string,total_cost_ed double")
    percents = rows([("23001", 6, 10.0)], "fips_code string,member_month int,ed_percent double")
    out = cost.member_costs(members, [(spend, ["total_cost_ed"])], percents, {"pmpy": "avoid_ed_cost"})
    assert dict(values(out, "beneID", "pmpy")) == {1: 10.0, 2: 0.0}


def test_funnel_counts_rows_and_groups(rows):
    df = rows([("A", 1, 1), ("A", 1, 0), ("B", None, 1), ("B", 0, 1)], "state string,a int,b int")
    out = cohort.funnel(df, [("a", F.col("a") == 1), ("b", F.col("b") == 1)], "state")
    assert sorted(values(out, "step", "name", "rows", "groups")) == [
        (0, "all", 4, 2), (1, "a", 2, 1), (2, "b", 1, 1),
    ]


def test_panel_combines_duplicate_rows(rows):
    families = {"days": panel.MonthFamily("D", "sum"), "code": panel.MonthFamily("C", "max")}
    wide = rows(
        [(1, "ME", 10, None, "01", None), (1, "ME", 5, None, "04", None), (None, "ME", 1, 1, "1", "1")],
        "BENE_ID int,STATE_CD string,D_01 int,D_02 int,C_01 string,C_02 string",
    )
    out = panel.monthly_panel(wide, {"BENE_ID": "beneID", "STATE_CD": "state"}, families, (1, 2))
    assert sorted(values(out, "month", "days", "code")) == [("1", 15, "04"), ("2", None, None)]


def test_claim_number_reused_in_another_month(rows):
    lines = rows([(1, "ME", 7, 1, "01"), (1, "ME", 7, 1, "02")], "BENE_ID int,STATE_CD string,CLM_ID int,LINE_NUM int,month string")
    headers = rows(
        [(1, "ME", 7, "1", "01"), (1, "ME", 7, "2", "02"), (1, None, 7, "1", "01")],
        "BENE_ID int,STATE_CD string,CLM_ID int,CLM_TYPE_CD string,month string",
    )
    assert values(claims.assemble_claims(lines, headers, month="month"), "month") == ["01"]


def test_missing_values_by_type(rows):
    df = rows(
        [("None", 1.0, 1), ("", float("nan"), None), (None, None, 2), ("x NULL", 2.0, 3), ("fine", 3.0, 4)],
        "a string,b double,c int",
    )
    assert dict(values(audit.missingness(df), "column", "missing")) == {"a": 4, "b": 2, "c": 1}


def test_member_shares_are_zero_not_null(rows):
    episodes = rows([(1, "ME", "23001", 1, 0, 0, 0)], "beneID int,state string,fips_code string,non_avoid_ip int,avoid_ip int,non_avoid_ed int,avoid_ed int")
    members = rows([(1, "ME", 7)], "beneID int,state string,medicaidMonths int")
    out = rates.member_counts(episodes, members).first()
    assert (out.ip_percent, out.ed_percent, out.acute_percent, out.member_month) == (0.0, 0.0, 0.0, 7)


def test_spread_ignores_nulls_and_ties(rows):
    df = rows([("g", v) for v in (1.0, 2.0, 2.0, 9.0, None)], "g string,v double")
    out = variation.spread(df, "g", {"rate": "v"}).first()
    assert (out.p25_rate, out.p75_rate, out.min_rate, out.max_rate, out.range_rate, out.iqr_rate) == (1.0, 2.0, 1.0, 9.0, 8.0, 1.0)


def test_regression_matches_least_squares(rows):
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(7)
    x = rng.normal(size=(30, 2))
    y = x @ [2.0, -1.0] + 3 + rng.normal(scale=0.1, size=30)
    table = rows([(i, float(y[i])) for i in range(30)], "state int,rate double")
    mix = rows([(i, float(x[i, 0]), float(x[i, 1])) for i in range(30)], "state int,a double,b double")
    out = adjust.adjusted(table, mix, "rate", features=["a", "b"])
    got = [p for _, p in sorted(values(out, "state", "prediction"))]
    design = np.column_stack([np.ones(30), x])
    assert np.allclose(got, design @ np.linalg.lstsq(design, y, rcond=None)[0], atol=1e-6)


def test_composition_adds_up(rows):
    df = rows([("ME", b) for b in ("under10", "under10", "missing", "50To64")], "state string,ageCat string")
    out = adjust.composition(df).first()
    assert (out.total, out.sum_under10_percentage, out.total_percentage) == (4, 50.0, 100.0)


def test_sinks_round_trip(spark, rows):
    df = rows([("a", 1), ("b", 2)], "part string,v int")
    saved = writers.save_table(df, "round_trip", ["part"], writers.shared_folder(spark, "t"))
    assert sorted(values(saved, "part", "v")) == [("a", 1), ("b", 2)]
    path = writers.shared_folder(spark, "csv")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    writers.save_csv(rows([("'J45'", "'Asthma'")], "diagnosisOne string,ccsrCatOne string"), path)
    lookup = readers.read_lookup(spark, path, readers.CATEGORY_SCHEMA, strip="'")
    assert values(lookup, "diagnosisOne", "ccsrCatOne") == [("J45", "Asthma")]


def test_lookups_lose_no_value_quietly(spark, rows):
    path = writers.shared_folder(spark, "csv")
    writers.save_csv(rows([("J45", "0.9"), ("J46", "n/a"), ("J47", None)], "code string,score string"), path)
    schema = StructType.fromDDL("code string, score double")
    with pytest.raises(Exception, match="n/a"):
        readers.read_lookup(spark, path, schema).collect()
    lenient = readers.read_lookup(spark, path, schema, rejected="bad")
    assert sorted(values(lenient, "code", "score", "bad"), key=str) == [("J45", 0.9, 0), ("J46", None, 1), ("J47", None, 0)]
    with pytest.raises(ValueError, match="weight"):
        readers.read_lookup(spark, path, StructType.fromDDL("code string, weight double"))


def test_crosswalks(spark):
    to_fips = dict(values(readers.state_to_fips(spark), "state", "fips_state"))
    to_state = dict(values(readers.fips_to_state(spark), "fips_state", "state_name"))
    assert len(to_fips) == 56 and len(to_state) == 51
    assert all(to_fips[s] == f for f, s in to_state.items())


def test_missing_text_expression_is_type_aware(rows):
    df = rows([("x", 1)], "a string,b int")
    assert df.select(is_missing("b", "int").alias("m")).first().m is False
