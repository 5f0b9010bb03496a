from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from panel360 import schemas
from panel360.operators import conform, gaps, gold, quality, risk, rollups

AS_OF = dt.date(2026, 8, 31)
CLINICS = {"P1": "NORTH", "P2": "SOUTH", "P3": "NORTH"}


def stay(pid, eid, end, los=1, source="EMERGENCY", kind="INPATIENT", start=dt.date(2026, 1, 1),
         readmit=0):
    return dict(patient_id=pid, encounter_id=eid, encounter_type=kind, start_date=start,
                end_date=end, length_of_stay_days=los, admission_source=source,
                readmit_30d=readmit)


def rows(df, key="patient_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_utilization_counts_and_six_month_edge(make):
    day = dt.date
    got = rows(rollups.patient_utilization(make(
        schemas.ENCOUNTERS,
        stay("P1", "E1", None, kind="EMERGENCY", start=day(2026, 2, 28)),
        stay("P1", "E2", None, kind="EMERGENCY", start=day(2026, 2, 27)),
        stay("P1", "E3", day(2026, 3, 4), los=3), stay("P1", "E4", day(2026, 2, 1), los=9)),
        AS_OF))["P1"]
    assert (got["encounter_count"], got["ed_count"], got["ed_visits_6mo"]) == (4, 2, 1)
    assert got["last_discharge_date"] == day(2026, 3, 4) and got["last_inpatient_los"] == 9


def test_last_admission_ranks_open_stays_last_and_breaks_ties(make):
    day = dt.date(2026, 3, 1)
    got = rows(rollups.last_admission(make(
        schemas.ENCOUNTERS, stay("P1", "E1", None), stay("P1", "E2", day), stay("P1", "E3", day),
        stay("P2", "E4", None), stay("P3", "E5", day, kind="OUTPATIENT"))))
    assert got["P1"]["encounter_id"] == "E3" and got["P2"]["encounter_id"] == "E4"
    assert "P3" not in got


def test_burden_caps_and_ignores_resolved(make):
    def dx(pid, code, weight, status="active", hcc=1):
        return dict(patient_id=pid, icd10_code=code, charlson_weight=weight,
                    clinical_status=status, hcc_flag=hcc)
    got = rows(rollups.patient_burden(make(
        schemas.DIAGNOSES, dx("P1", "I50.9", 4), dx("P1", "E11.22", 2), dx("P1", "N18.4", 9,
                                                                          "resolved"),
        dx("P2", "J44.1", None), dx("P3", "I50.9", 4))))
    assert (got["P1"]["charlson_raw"], got["P1"]["charlson_capped"]) == (6, 5)
    assert got["P1"]["has_chf"] and got["P1"]["has_t2dm"] and not got["P1"]["has_ckd"]
    assert got["P1"]["hcc_condition_count"] == 2
    assert got["P2"]["charlson_raw"] is None and got["P2"]["charlson_capped"] is None
    assert got["P3"]["charlson_capped"] == 4


def p360(make, spark, encounters=(), diagnoses=(), medications=(), labs=(), claims=(), signals=(),
         los_basis="max"):
    patients = make(schemas.PATIENTS, *[dict(patient_id=p, member_id="M" + p, first_name="ann",
                                             last_name="smith-jones", sex="F",
                                             birth_date=dt.date(1950, 12, 31)) for p in CLINICS])
    members = make(schemas.MEMBERS, *[dict(member_id="M" + p, patient_id=p, attributed_clinic=c,
                                           line_of_business="MEDICARE",
                                           enroll_start=dt.date(2026, 1, 31))
                                      for p, c in CLINICS.items()])
    signal_rows = spark.createDataFrame(
        [tuple(s) for s in signals], "patient_id string, has_barrier boolean, "
        "barrier_to_care string, adverse_event string, followup_days int")
    facts = gold.Facts(make(schemas.ENCOUNTERS, *encounters), make(schemas.DIAGNOSES, *diagnoses),
                       make(schemas.MEDICATIONS, *medications), make(schemas.LABS, *labs),
                       make(schemas.CLAIMS, *claims), signal_rows)
    dim = conform.dim_patient(patients, members, AS_OF)
    return gold.patient_360(dim, facts, AS_OF, los_basis)


def test_360_has_one_row_per_patient_and_defaults(make, spark):
    got = rows(p360(make, spark))
    assert set(got) == set(CLINICS)
    row = got["P1"]
    assert len(row) == 57 and row["full_name"] == "Ann Smith-Jones" and row["age_years"] == 76
    assert row["encounter_count"] == 0 and row["has_chf"] is False
    assert row["total_allowed_amount"] == Decimal("0") and row["worst_pdc"] is None
    with pytest.raises(ValueError):
        p360(make, spark, los_basis="median")


@pytest.mark.parametrize("los, points", [(0, 0), (1, 1), (3, 3), (4, 4), (6, 4), (7, 5), (13, 5),
                                         (14, 7), (None, 0)])
def test_stay_points(make, spark, los, points):
    stays = [] if los is None else [stay("P1", "E1", dt.date(2026, 3, 1), los, "ELECTIVE")]
    assert rows(risk.risk_score(p360(make, spark, stays)))["P1"]["l_points"] == points


def test_score_and_text(make, spark):
    day = dt.date(2026, 3, 1)
    ed = [stay("P1", f"X{i}", None, 0, "N/A", "EMERGENCY", dt.date(2026, 8, 1)) for i in range(5)]
    table = p360(
        make, spark,
        [stay("P1", "E1", day, 9), stay("P1", "E2", dt.date(2026, 2, 1), 15, "ELECTIVE"), *ed],
        [dict(patient_id="P1", icd10_code="I50.9", charlson_weight=6, clinical_status="active")],
        [dict(patient_id="P1", drug_class="statin", adherence_pdc=Decimal("0.79"), active_flag=1),
         dict(patient_id="P2", drug_class="statin", adherence_pdc=Decimal("0.80"),
              active_flag=1)],
        signals=[("P1", True, "cost", "NONE", 7), ("P1", False, "zz none", "NONE", 3)])
    got = rows(risk.risk_score(table))
    one = got["P1"]
    assert [one[c] for c in ("l_points", "a_points", "c_points", "e_points")] == [7, 3, 5, 4]
    assert one["lace_index"] == 19 and one["adjusted_score"] == 21 and one["risk_band"] == "HIGH"
    assert one["score_explanation"] == (
        "LACE 19 = L7 (last LOS 15d) + A3 (admission source EMERGENCY) + C5 (Charlson 6, capped "
        "at 5) + E4 (5 ED visits in prior 6 months). Local modifiers +2 (lowest active-medication "
        "PDC 0.79; documented barrier: cost)")
    assert got["P2"]["mod_adherence_point"] == 0
    assert got["P3"]["score_explanation"] == (
        "LACE 0 = L0 (no inpatient stay) + A0 (admission source none) + C0 (Charlson 0, capped at "
        "5) + E0 (0 ED visits in prior 6 months)")
    parts = risk.score_components(risk.risk_score(table)).filter("patient_id = 'P1'").collect()
    assert sum(r.points for r in parts) == 21 and len(parts) == 6


def test_los_basis_can_follow_the_index_stay(make, spark):
    stays = [stay("P1", "E1", dt.date(2026, 3, 1), 2), stay("P1", "E2", dt.date(2026, 1, 9), 15)]
    assert rows(p360(make, spark, stays))["P1"]["last_inpatient_los"] == 15
    assert rows(p360(make, spark, stays, los_basis="index_stay"))["P1"]["last_inpatient_los"] == 2


def test_gaps_equal_the_six_filters(make, spark):
    def med(pid, drug):
        return dict(patient_id=pid, drug_class=drug, adherence_pdc=Decimal("0.79"), active_flag=1)

    def lab(pid, code, value):
        return dict(patient_id=pid, loinc_code=code, result_value=Decimal(value))
    table = p360(
        make, spark, [stay("P1", "E1", dt.date(2026, 3, 1))],
        [dict(patient_id=p, icd10_code=c, charlson_weight=1, clinical_status="active")
         for p, c in (("P1", "I50.9"), ("P2", "E11.9"), ("P2", "N18.4"), ("P3", "E11.9"))],
        [med("P2", "biguanide"), med("P3", "biguanide"), med("P3", "MRA")],
        [lab("P2", "4548-4", "7.000"), lab("P3", "4548-4", "6.900"), lab("P3", "2823-3", "5.500"),
         lab("P2", "2823-3", "5.500")],
        signals=[("P1", True, "cost", "NONE", 7)])
    got = {(r.patient_id, r.gap_type) for r in gaps.care_gaps(table).collect()}
    union = {(r.patient_id, rule.gap_type) for rule in gaps.RULES
             for r in table.filter(rule.predicate).collect()}
    assert got == union == {
        ("P1", "CHF_NO_GDMT_ON_FILE"), ("P1", "POST_DISCHARGE_FOLLOWUP_AT_RISK"),
        ("P2", "T2DM_A1C_ABOVE_TARGET_NO_STEP_UP"), ("P2", "CKD_SGLT2_ELIGIBLE_NOT_ON_THERAPY"),
        ("P2", "LOW_ADHERENCE_RENEWAL_RISK"), ("P3", "LOW_ADHERENCE_RENEWAL_RISK"),
        ("P3", "HYPERKALEMIA_MONITORING_DUE")}
    assert {r.patient_id: r.open_gaps for r in gaps.gap_counts(table).collect()} == {
        "P1": 2, "P2": 3, "P3": 2}


def test_member_360_without_claims_is_null(make):
    members = make(schemas.MEMBERS, dict(member_id="M1", patient_id="P1",
                                         enroll_start=dt.date(2026, 1, 31)),
                   dict(member_id="M2", patient_id="P2", enroll_start=dt.date(2025, 12, 1)))
    claims = make(schemas.CLAIMS, *[dict(patient_id="P1", claim_id=str(i), claim_status=s,
                                         allowed_amount=Decimal("10.50"))
                                    for i, s in enumerate(("DENIED", "PAID", "PAID", "PENDING"))])
    got = rows(gold.member_360(members, claims, AS_OF), "member_id")
    assert got["M1"]["denial_rate"] == 0.25 and got["M1"]["months_enrolled"] == 7
    assert got["M1"]["total_allowed_amount"] == Decimal("42.00")
    assert got["M2"]["claim_count"] is None and got["M2"]["denial_rate"] is None


def test_band_calibration_denominators(spark):
    scored = spark.createDataFrame([("P1", "HIGH", 10), ("P2", "HIGH", 12), ("P3", "LOW", 1)],
                                   "patient_id string, risk_band string, lace_index long")
    outcomes = spark.createDataFrame([("P1", 1)], "patient_id string, outcome int")
    by_stay = rows(risk.band_calibration(scored, outcomes), "risk_band")
    by_all = rows(risk.band_calibration(scored, outcomes, "all"), "risk_band")
    assert by_stay["HIGH"]["observed_readmit_rate"] == 1.0
    assert by_stay["LOW"]["observed_readmit_rate"] is None
    assert by_all["HIGH"]["observed_readmit_rate"] == 0.5


def test_quality_checks_find_each_failure(make, spark):
    day = dt.date(2026, 1, 1)
    dim = spark.createDataFrame([("P1", -1), ("P2", 121), ("P3", 120)],
                                "patient_id string, age_years int")
    encounters = make(schemas.ENCOUNTERS, stay("P1", "E1", dt.date(2026, 1, 3), 2),
                      stay("P1", "E1", dt.date(2026, 1, 3), 2),
                      stay("P9", "E2", dt.date(2026, 1, 3), 5), stay(None, "E3", day, 0, "N/A"))
    claims = make(schemas.CLAIMS, dict(claim_id="1", encounter_id="E1",
                                       allowed_amount=Decimal("-1")),
                  dict(claim_id="2", encounter_id="E8", allowed_amount=Decimal("1")),
                  dict(claim_id="3", encounter_id="E8"), dict(claim_id="4"))
    checks = quality.dq_checks(dim, encounters, claims)
    assert {r.check_name: r.failing_rows for r in checks.collect()} == {
        "orphan_encounters": 2, "inpatient_missing_admission_source": 1,
        "los_exceeds_stay_window": 1, "orphan_claims": 3, "negative_allowed_amount": 1,
        "implausible_age": 2}
    assert quality.dq_gate(checks).first().released is False
    with pytest.raises(quality.GateFailed, match="orphan_claims: 3"):
        quality.enforce_gate(checks)
    with pytest.raises(ValueError):
        quality.column_tests(dim, quality.ColumnTests())


def test_the_360_joins_active_rows_alone(panel):
    """Both filters stand below the joins that find the patient."""
    text = panel.p360._jdf.queryExecution().optimizedPlan().toString()
    for source in ("l_linestatus", "l_returnflag"):
        assert any(line.lstrip(" :+-").startswith("Filter") and source in line for line in text.split("\n")), source
