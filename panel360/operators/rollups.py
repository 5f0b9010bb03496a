"""One row per patient from each fact table.

Every rollup is an aggregate combined on the map side first: a patient holding a third of a fact
table still sends one row per task to the shuffle. Its side of a join is unique by patient, so the
optimizer drops a rollup whose columns a query does not use.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Diagnosis codes, drug classes and laboratory codes the rollups look for.
CONDITION_FLAGS = {"has_chf": "icd10_code = 'I50.9'", "has_t2dm": "icd10_code LIKE 'E11%'",
                   "has_ckd": "icd10_code LIKE 'N18%'", "has_copd": "icd10_code LIKE 'J44%'"}
DRUG_FLAGS = {"on_arni": "ARNI", "on_mra": "MRA", "on_sglt2": "SGLT2 inhibitor",
              "on_metformin": "biguanide", "on_loop_diuretic": "loop diuretic"}
LAB_CODES = {"a1c": "4548-4", "creatinine": "2160-0", "ntprobnp": "33762-6",
             "potassium": "2823-3"}
CHARLSON_CAP = 5
ACTIVE_DIAGNOSIS, ACTIVE_MEDICATION = "clinical_status = 'active'", "active_flag = 1"
STAY_COLUMNS = ("encounter_id", "start_date", "end_date", "length_of_stay_days", "admission_source",
                "discharge_disposition", "facility", "readmit_30d")


def _per_patient(facts: DataFrame, **measures: str) -> DataFrame:
    return facts.groupBy("patient_id").agg(*[F.expr(f"{sql} AS {name}")
                                             for name, sql in measures.items()])


def patient_utilization(encounters: DataFrame, as_of: dt.date) -> DataFrame:
    """Counts by setting, emergency visits in the six calendar months before `as_of`, last
    discharge and longest inpatient stay."""
    inpatient, emergency = "encounter_type = 'INPATIENT'", "encounter_type = 'EMERGENCY'"
    recent = f"start_date >= add_months(DATE '{as_of}', -6)"
    return _per_patient(
        encounters,
        encounter_count="count(*)",
        inpatient_count=f"count_if({inpatient})",
        ed_count=f"count_if({emergency})",
        ed_visits_6mo=f"count_if({emergency} AND {recent})",
        last_discharge_date=f"max(end_date) FILTER (WHERE {inpatient})",
        last_inpatient_los=f"max(length_of_stay_days) FILTER (WHERE {inpatient})",
        any_readmit_30d="max(readmit_30d)")


def _index_stays(encounters: DataFrame, *columns: str) -> DataFrame:
    """The most recent inpatient stay of each patient. Open stays (no end date) rank last; equal end
    dates fall back to the encounter id."""
    kept = ", ".join(c for c in STAY_COLUMNS if c not in ("end_date", "encounter_id"))
    return _per_patient(
        encounters.filter("encounter_type = 'INPATIENT'"),
        _last=f"max(struct(end_date IS NOT NULL AS ended, end_date, encounter_id, {kept}))",
    ).selectExpr("patient_id", *[f"_last.{c}" for c in columns])


def last_admission(encounters: DataFrame) -> DataFrame:
    """The last inpatient stay, by discharge date."""
    return _index_stays(encounters, *STAY_COLUMNS[:-1])


def index_outcomes(encounters: DataFrame) -> DataFrame:
    """Whether the last stay was followed by a readmission (0/1)."""
    return _index_stays(encounters, "readmit_30d AS outcome")


def patient_burden(diagnoses: DataFrame) -> DataFrame:
    """Charlson weight of active conditions, raw and capped, and condition flags. The published
    index scores a Charlson sum of 4 as 5; this one keeps the sum and caps it at 5."""
    active = ACTIVE_DIAGNOSIS
    weight = f"sum(CASE WHEN {active} THEN charlson_weight ELSE 0 END)"
    return _per_patient(
        diagnoses,
        charlson_raw=weight,
        charlson_capped=f"CASE WHEN {weight} IS NOT NULL "
                        f"THEN least({weight}, {CHARLSON_CAP}L) END",
        active_condition_count=f"count_if({active})",
        hcc_condition_count=f"count_if({active} AND hcc_flag = 1)",
        **{flag: f"bool_or({active} AND {test})" for flag, test in CONDITION_FLAGS.items()})


def patient_pharmacy(medications: DataFrame) -> DataFrame:
    """Active medication count, lowest adherence and therapy flags."""
    active = ACTIVE_MEDICATION
    return _per_patient(
        medications,
        active_med_count=f"count_if({active})",
        worst_pdc=f"min(adherence_pdc) FILTER (WHERE {active})",
        **{flag: f"bool_or({active} AND drug_class = '{drug}')"
           for flag, drug in DRUG_FLAGS.items()})


def patient_labs(labs: DataFrame) -> DataFrame:
    """Highest result per followed test and the abnormal count. The `latest_` names are those the
    published model uses; the value is the maximum. `latest_results` gives the true latest."""
    return _per_patient(
        labs,
        **{f"latest_{name}": f"max(result_value) FILTER (WHERE loinc_code = '{code}')"
           for name, code in LAB_CODES.items()},
        abnormal_result_count="count_if(abnormal_flag = 1)")


def latest_results(labs: DataFrame) -> DataFrame:
    """Most recent result per followed test; of several on one day, the highest."""
    newest = "max(struct(collected_date, result_value))"
    return _per_patient(labs, **{
        f"newest_{name}": f"({newest} FILTER (WHERE loinc_code = '{code}')).result_value"
        for name, code in LAB_CODES.items()})


def patient_financial(claims: DataFrame) -> DataFrame:
    """Allowed, paid and liability totals, denied count and claim count."""
    return _per_patient(
        claims,
        total_allowed_amount="sum(allowed_amount)",
        total_paid_amount="sum(paid_amount)",
        total_member_liability="sum(member_liability)",
        denied_claim_count="count_if(claim_status = 'DENIED')",
        claim_count="count(*)")


def patient_signals(signals: DataFrame) -> DataFrame:
    """Narrative signals per patient. Only notes that do report a barrier give the barrier text."""
    return _per_patient(
        signals,
        has_barrier="bool_or(has_barrier)",
        barrier_to_care="max(barrier_to_care) FILTER (WHERE has_barrier)",
        adverse_event="max(adverse_event)",
        followup_days="min(followup_days)")
