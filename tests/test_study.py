"""The whole study on small source tables in the warehouse layout."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from claimloom.functions import codes
from claimloom.operators import audit, cohort, cost, panel, variation
from claimloom.plans import study

MONTHS = ("01", "02")
STATES = ("ME", "AK", "VA")
DX = ("J45", "I10", "E11", "S72")
FIRST = date(2019, 1, 1)


def eligibility(rng, members):
    rows = []
    for beneficiary, state in members:
        row = {
            "BENE_ID": beneficiary, "STATE_CD": state, "BENE_STATE_CD": codes.STATE_FIPS[state],
            "BENE_CNTY_CD": rng.choice(["001", "003"]), "BENE_ZIP_CD": "00001", "AGE": rng.choice([5, 20, 35, 50, 70, None]),
            "AGE_GRP_CD": "1", "DEATH_IND": "0", "SEX_CD": rng.choice(["M", "F", None]), "RACE_ETHNCTY_CD": rng.choice(["1", "2"]),
            "ENGLSH_LANG_PRFCNCY_CD": "0", "MRTL_STUS_CD": "01", "HSEHLD_SIZE_CD": "02", "INCM_CD": "01",
            "CTZNSHP_IND": "1", "SSDI_IND": "0", "SSI_IND": "0", "TANF_CASH_CD": "1",
        }
        row |= {f: 0.0 for f in codes.DISABILITY_FLAGS}
        dual = "02" if rng.random() < 0.1 else "00"
        for m in range(1, 13):
            row |= {
                f"MDCD_ENRLMT_DAYS_{m:02d}": rng.choice([0, 30, 31]), f"CHIP_ENRLMT_DAYS_{m:02d}": 0,
                f"DUAL_ELGBL_CD_{m:02d}": dual, f"MC_PLAN_TYPE_CD_{m:02d}": "01", f"CHIP_CD_{m:02d}": "1",
            }
        rows.append(row)
    return rows


def schema_of(rows):
    kind = {int: "int", float: "double", str: "string", date: "date"}
    types = {}
    for row in rows:
        for name, value in row.items():
            if value is not None:
                types[name] = kind[type(value)]
    return ", ".join(f"{n} {types.get(n, 'string')}" for n in rows[0])


def claim_tables(rng, members, inpatient):
    """Lines and headers by month."""
    lines, headers = defaultdict(list), defaultdict(list)
    columns = (study.INPATIENT_LINE, study.INPATIENT_HEADER) if inpatient else (study.OTHER_LINE, study.OTHER_HEADER)
    for number in range(150 if inpatient else 300):
        month = rng.choice(MONTHS)
        beneficiary, state = rng.choice(members)
        start = FIRST + timedelta(days=rng.randrange(60))
        header = {
            "BENE_ID": beneficiary, "STATE_CD": state, "CLM_ID": f"{'i' if inpatient else 'o'}{number}",
            "CLM_TYPE_CD": rng.choice(["1", "3", "2"]), "BILL_TYPE_CD": "111", "SRVC_BGN_DT": start,
            "SRVC_END_DT": start + timedelta(days=rng.randrange(5)), "DGNS_CD_1": rng.choice(DX),
            "POS_CD": rng.choice(["23", "11", "1A"]), "MDCD_PD_AMT": float(rng.randrange(1000)),
        }
        headers[month].append({c: header.get(c, "x" if not c.endswith("AMT") else 1.0) for c in columns[1]})
        for line in range(1, rng.randrange(2, 5)):
            values = {
                "BENE_ID": beneficiary, "STATE_CD": state, "CLM_ID": header["CLM_ID"], "LINE_NUM": line,
                "REV_CNTR_CD": rng.choice(["0450", "0100"]), "LINE_PRCDR_CD": rng.choice(["99281", "00000"]),
                "LINE_MDCD_PD_AMT": float(rng.randrange(100)), "LINE_MDCD_FFS_EQUIV_AMT": float(rng.randrange(100)),
            }
            lines[month].append({c: values.get(c, "x" if not c.endswith("AMT") else 1.0) for c in columns[0]})
    return lines, headers


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    rng = random.Random(11)
    members = [(f"b{i}", rng.choice(STATES)) for i in range(80)]
    people = eligibility(rng, members + [("b1", "VA" if members[1][1] != "VA" else "ME")])
    folder = tmp_path_factory.mktemp("study")

    def put(name, rows):
        path = str(folder / "in" / name)
        spark.createDataFrame([tuple(r.values()) for r in rows], schema_of(rows)).write.option("path", path).saveAsTable(name)

    put("src_elig", people)
    put("src_county", [
        {"BENE_ID": b, "STATE_CD": s, "BENE_CNTY_CD": "x", "county_code": rng.choice(["001", "003"])} for b, s in members
    ])
    source = {"lines": {}, "headers": {}}
    for kind, inpatient in (("ip", True), ("os", False)):
        lines, headers = claim_tables(rng, members, inpatient)
        source["lines"][kind], source["headers"][kind] = lines, headers
        for month in MONTHS:
            put(f"src_{kind}_line_{month}", lines[month])
            put(f"src_{kind}_header_{month}", headers[month])
    scores, listed = str(folder / "ed.csv"), str(folder / "ip.csv")
    with open(scores, "w") as f:
        f.write(",dx,ednnp,ednp,pct,nonemergent,alcohol,drug,injury,psych,unclassified\n0,J45,0.1,0.3,0.3,0.2,0,0,0,0,0\n1,I10,0.5,0.1,0.1,0.1,0,0,0,0,0\n")
    with open(listed, "w") as f:
        f.write("diagnosisOne,pqiLabel,icd10Label,pqiNum\nE11,Diabetes,x,1\nE11,Diabetes,y,2\n")
    sources = study.Sources(
        "src_elig", "src_ip_line_{month}", "src_ip_header_{month}", "src_os_line_{month}", "src_os_header_{month}",
        "src_county", scores, listed, MONTHS,
    )
    target = study.Target(
        "default", str(folder / "release"), str(folder / "out"), minimum_members=5, small_cell=0, excluded_states=(),
    )
    return study.run(spark, sources, target), source, members, folder


def test_panel_covers_enrolled_months_only(results):
    tables, *_ = results
    enrolment = tables["enrolment"]
    assert enrolment.where("medicaidDays <= 0 or enrolled = 'no'").count() == 0
    keys = enrolment.groupBy("beneID", "state", "month").count().where("count > 1")
    assert keys.count() == 0


def test_member_seen_in_two_states_is_left_out(results):
    tables, *_ = results
    sample = tables["sample"]
    assert sample.where("beneID = 'b1'").count() == 0
    assert sample.where("age >= 65 or age is null or medicareMonths > 0").count() == 0
    assert sample.count() == sample.select("beneID").distinct().count() > 20


def test_claim_lines_match_a_nested_loop(results):
    tables, source, *_ = results
    expected = Counter()
    for kind, table in (("ip", "inpatient_claims"), ("os", "other_claims")):
        for month in MONTHS:
            wanted = {
                (h["BENE_ID"], h["STATE_CD"], h["CLM_ID"]) for h in source["headers"][kind][month] if h["CLM_TYPE_CD"] in "13"
            }
            expected[table] += sum((r["BENE_ID"], r["STATE_CD"], r["CLM_ID"]) in wanted for r in source["lines"][kind][month])
        assert tables[table].count() == expected[table]


def test_episodes_are_exclusive_and_add_up(results):
    tables, *_ = results
    episodes, counties = tables["episodes"], tables["counties"]
    classes = "non_avoid_ip + avoid_ip + non_avoid_ed + avoid_ed"
    assert episodes.where(f"{classes} <> 1").count() == 0
    assert episodes.count() == counties.agg(F.sum("all_cause_acute")).first()[0] > 0
    assert counties.where("total_members < 5").count() == 0
    assert counties.agg(F.sum("total_members")).first()[0] == tables["sample_screened"].count()


def test_every_visit_is_inside_its_members_episodes(results):
    tables, *_ = results
    visits, episodes = tables["visits"], tables["episodes_all"]
    covered = visits.alias("v").join(
        episodes.select("beneID", "state", F.col("StartDate").alias("s"), F.col("EndDate").alias("e")), ["beneID", "state"]
    ).where("v.StartDate >= s and v.EndDate <= e")
    assert covered.select("beneID", "CLM_ID").distinct().count() == visits.select("beneID", "CLM_ID").distinct().count()


def test_rates_agree_with_the_county_file(results):
    tables, *_ = results
    total = tables["counties"].agg(F.sum("avoid_ed"), F.sum("member_month")).first()
    overall = tables["rates_overall"].first()
    assert overall.avoid_ed == pytest.approx(round(total[0] / total[1] * 1000, 1), abs=0.1)
    assert {r.state_name for r in tables["rates_state"].collect()} <= set(STATES)
    assert tables["rates_county"].count() == tables["counties"].count()


def test_costs_stay_in_scope_and_members_add_up(results):
    tables, *_ = results
    for kind, states in (("total", codes.TOTAL_COST_STATES), ("ed", codes.ED_COST_STATES), ("ip", codes.INPATIENT_COST_STATES)):
        assert {r.state for r in tables[f"cost_{kind}_county"].collect()} <= set(states)
    scoped = tables["sample_screened"].where(F.col("state").isin(*codes.ED_COST_STATES))
    assert tables["cost_ed_member"].count() == scoped.count()
    by_member = tables["cost_ed_member"].agg(F.sum("total_cost_ed")).first()[0]
    by_state = tables["cost_ed_state"].agg(F.sum("total_cost_ed")).first()[0]
    assert by_member == pytest.approx(by_state)


def test_savings_are_not_negative(results):
    tables, *_ = results
    assert tables["savings_county"].where("saving_ed < 0 or saving_ip < 0").count() == 0
    parts = tables["savings_state"].where("state is not null").agg(F.sum("saving_total")).first()[0]
    assert parts == pytest.approx(tables["savings_state"].where("state is null").first().saving_total)


def test_descriptive_percents_per_variable(results):
    tables, *_ = results
    rows = tables["descriptive"].groupBy("variable").agg(F.sum("Count").alias("n"), F.sum("Percentage").alias("p")).collect()
    assert {r.variable for r in rows} == set(codes.DESCRIPTIVE_COLUMNS)
    assert {r.n for r in rows} == {tables["sample_screened"].count()}
    assert all(abs(r.p - 100) < 0.5 for r in rows)


def test_releases_are_written(spark, results):
    *_, folder = results
    for name in ("utilisation_county", "counties_suppressed", "member_months", "spend_total", "spend_ed", "spend_ip"):
        assert spark.read.csv(str(folder / "release" / name), header=True).columns
    spend = spark.read.csv(str(folder / "release" / "spend_total"), header=True)
    assert spend.columns == ["fips_code", "state", "avoid_ed_cost", "avoid_ip_cost", "avoid_acute_cost", "acute_pmpy"]


def test_age_adjustment_has_a_row_per_state(results):
    tables, *_ = results
    assert tables["age_adjusted"].count() == tables["rates_state"].count()


def test_diagnosis_categories_count_avoidable_episodes(spark, results):
    tables, *_ = results
    categories = spark.createDataFrame([("J45", "resp"), ("E11", "endo")], "diagnosisOne string, ccsrCatOne string")
    out = study.diagnosis_categories(tables["visits"], categories).collect()
    avoidable = tables["episodes_all"].agg(F.sum("avoid_ip"), F.sum("avoid_ed")).first()
    totals = Counter()
    for r in out:
        totals[r.kind] += r.episodes
    assert (totals["ip"], totals["ed"]) == tuple(avoidable)
    assert {r.ccsrCatOne for r in out if r.kind == "ip"} == {"endo"}


def test_completeness_has_state_and_total_rows(results):
    tables, *_ = results
    out = {r.STATE_CD: r for r in tables["inpatient_completeness"].collect()}
    assert out[None].totalClaims == sum(r.totalClaims for s, r in out.items() if s)
    assert all(r["all"] <= r.noProc <= r.noProcDrg <= r.totalClaims for r in out.values())


def test_panel_families_name_the_source_columns():
    assert {f.how for f in panel.ENROLMENT_FAMILIES.values()} == {"sum", "max"}


def test_cost_tables_equal_those_from_the_claim_lines(results):
    tables, *_ = results
    members, rate = tables["sample_screened"], {"state": tables["rates_state"], "county": tables["rates_county"]}
    for name, (states, _) in study.COST_STUDIES.items():
        stays = cohort.scoped_claims(tables["inpatient_cohort"], members, states)
        services = cohort.scoped_claims(tables["other_cohort"], members, states)
        for unit, keys in (("state", ["state"]), ("county", ["fips_code", "state"])):
            if name == "ed":
                direct = cost.ed_cost(services, keys)
            else:
                direct = cost.inpatient_cost(stays, keys)
                if name == "total":
                    direct = cost.combine_costs(direct, [cost.service_costs(services, keys)], keys)
            columns = [*keys, *[c for c in ("inpatient_cost", "total_cost_ed", "total_cost_other") if c in direct.columns]]

            def rounded(df):
                return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=repr)

            assert rounded(tables[f"cost_{name}_{unit}"]) == rounded(direct)
        users = tables[f"cost_{name}_member"]
        assert users.count() == members.where(F.col("state").isin(*states)).count()


def test_cost_stage_reads_each_claim_file_once(results):
    tables, *_ = results

    def scans(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("_cohort")

    assert scans(study.inpatient_spend(tables["inpatient_cohort"], tables["sample_screened"])) == 1
    assert scans(study.service_spend(tables["other_cohort"], tables["sample_screened"])) == 1
    spend = {"stays": tables["spend_inpatient"], "services": tables["spend_services"]}
    for name in study.COST_STUDIES:
        assert scans(study.unit_cost_table(name, "county", tables["rates_county"], **spend)) == 0
        assert scans(study.member_cost_table(name, tables["sample_screened"], tables["rates_county"], **spend)) == 0


def test_reports_come_from_their_operators(results):
    tables, *_ = results

    def same(name, df):
        assert sorted(map(repr, tables[name].collect())) == sorted(map(repr, df.collect())), name

    same("demographics_coverage", audit.coverage(tables["demographics"]))
    same("demographics_missing", audit.missingness(tables["demographics"]))
    same("screening", cohort.screening_report(tables["counties_all"], 5))
    same("inpatient_payments", study.inpatient_payment_completeness(tables["inpatient_claims"]))
    same("other_payments", study.other_payment_completeness(tables["other_claims"]))
    same("county_sizes", variation.size_summary(tables["counties"], "total_members"))
    same("rates_distribution_states", variation.distribution(tables["rates_state"], study.RATE_MEASURES))
    same("ranges_within_state_acute", variation.distribution(tables["within_state_acute"], ["range_rate", "range_percent"]))
    same("ranges_within_county_acute", variation.distribution(tables["within_county_acute"], ["range_rate", "iqr_percent"]))
    same("cost_total_distribution_members", variation.distribution(tables["cost_total_member"], ["pmpy"]))
    same("cost_ed_ranges_within_county", variation.distribution(tables["cost_ed_within_county"], ["range_rate"]))
    funnel = {r["name"]: r["rows"] for r in tables["sample_funnel"].collect()}
    assert funnel["all"] == tables["demographics"].count() and funnel["under 65"] >= tables["sample"].count()
