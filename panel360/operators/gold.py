"""The one-row-per-patient and one-row-per-member tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panel360.functions import as_ntz, div0, month_boundaries
from panel360.operators import rollups

DATA_CLASSIFICATION = "SYNTHETIC"
ROW_KEYS = ("patient_id", "member_id", "full_name", "first_name", "last_name", "birth_date",
            "age_years", "sex", "city", "state", "postal_code", "primary_language", "pcp_npi",
            "payer_name", "plan_id", "line_of_business", "risk_program", "attributed_clinic")


@dataclass(frozen=True)
class Facts:
    """Inputs of the 360. `signals` are the typed narrative signals, one row per note."""

    encounters: DataFrame
    diagnoses: DataFrame
    medications: DataFrame
    labs: DataFrame
    claims: DataFrame
    signals: DataFrame


def _or(default: str, *names: str) -> list[str]:
    return [f"coalesce({name}, {default}) AS {name}" for name in names]


def patient_360(dim: DataFrame, facts: Facts, as_of: dt.date, los_basis: str = "max",
                built_at: dt.datetime | None = None) -> DataFrame:
    """Patients left-joined to seven rollups of one row per patient each.

    Each rollup is already partitioned on patient_id by its own aggregation, so the joins add no
    shuffle beyond one for the dimension, and a join whose columns a caller does not use is dropped by
    the optimizer because the rollup side is unique. Only active diagnoses and medications count, and a
    patient without any has the values of one without rows, so the others are left out before the source
    tables are joined. `los_basis` chooses the stay length
    scored later: "max" over all stays, or "index_stay" for the last one.
    """
    if los_basis not in ("max", "index_stay"):
        raise ValueError(f"unknown los_basis {los_basis!r}")
    stay = rollups.last_admission(facts.encounters).selectExpr(
        "patient_id", "admission_source AS last_admission_source",
        "discharge_disposition AS last_discharge_disposition",
        "encounter_id AS last_inpatient_encounter_id", "length_of_stay_days AS _index_los")
    sides = (rollups.patient_utilization(facts.encounters, as_of), stay,
             rollups.patient_burden(facts.diagnoses.filter(rollups.ACTIVE_DIAGNOSIS)),
             rollups.patient_pharmacy(facts.medications.filter(rollups.ACTIVE_MEDICATION)),
             rollups.patient_labs(facts.labs), rollups.patient_financial(facts.claims),
             rollups.patient_signals(facts.signals))
    joined = dim
    for side in sides:
        joined = joined.join(side, "patient_id", "left")
    los = "last_inpatient_los" if los_basis == "max" else "_index_los"
    rows = joined.selectExpr(
        *ROW_KEYS,
        *_or("0L", "encounter_count", "inpatient_count", "ed_count", "ed_visits_6mo"),
        "last_discharge_date", f"{los} AS last_inpatient_los", *_or("0", "any_readmit_30d"),
        "last_admission_source", "last_discharge_disposition", "last_inpatient_encounter_id",
        *_or("0L", "charlson_raw", "charlson_capped", "active_condition_count",
             "hcc_condition_count"),
        *_or("false", "has_chf", "has_t2dm", "has_ckd", "has_copd"),
        *_or("0L", "active_med_count"), "worst_pdc",
        *_or("false", "on_arni", "on_mra", "on_sglt2", "on_metformin"),
        "latest_a1c", "latest_creatinine", "latest_ntprobnp", "latest_potassium",
        *_or("0L", "abnormal_result_count"),
        *_or("0", "total_allowed_amount", "total_paid_amount"),
        *_or("0L", "denied_claim_count", "claim_count"),
        "coalesce(has_barrier, false) AS documented_barrier_to_care", "barrier_to_care",
        "adverse_event AS documented_adverse_event",
        "followup_days AS recommended_followup_days",
        f"'{DATA_CLASSIFICATION}' AS data_classification")
    return rows.withColumn("built_at", as_ntz(built_at))


def member_360(members: DataFrame, claims: DataFrame, as_of: dt.date) -> DataFrame:
    """Members with tenure and claim economics; a member without claims has NULL economics."""
    economics = rollups.patient_financial(claims)
    joined = members.join(economics, "patient_id", "left").withColumns({
        "months_enrolled": month_boundaries(F.col("enroll_start"), F.lit(as_of)),
        "denial_rate": div0(F.col("denied_claim_count"), F.col("claim_count"))})
    return joined.selectExpr(
        "member_id", "patient_id", "payer_name", "plan_id", "line_of_business", "risk_program",
        "attributed_clinic", "enroll_start", "months_enrolled", "claim_count",
        "denied_claim_count", "denial_rate", "total_allowed_amount", "total_paid_amount",
        "total_member_liability", f"'{DATA_CLASSIFICATION}' AS data_classification")
