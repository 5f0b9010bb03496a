"""Schemas of the eight structured extracts, in file order (files are loaded by position)."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    fields = [part.split() for part in ddl.replace("\n", " ").split(";") if part.strip()]
    kinds = {"string": T.StringType(), "date": T.DateType(), "int": T.IntegerType(),
             "money": T.DecimalType(18, 2), "lab": T.DecimalType(18, 3),
             "ratio": T.DecimalType(4, 2)}
    return T.StructType([T.StructField(name, kinds[kind], True) for name, kind in fields])


PATIENTS = _schema("""
    patient_id string; member_id string; first_name string; last_name string; birth_date date;
    sex string; city string; state string; postal_code string; primary_language string;
    pcp_npi string; deceased_flag int; data_source string""")

MEMBERS = _schema("""
    member_id string; patient_id string; payer_name string; plan_id string;
    line_of_business string; enroll_start date; enroll_end date; risk_program string;
    attributed_clinic string""")

ENCOUNTERS = _schema("""
    encounter_id string; patient_id string; encounter_type string; start_date date;
    end_date date; length_of_stay_days int; admission_source string;
    discharge_disposition string; facility string; readmit_30d int""")

CLAIMS = _schema("""
    claim_id string; encounter_id string; member_id string; patient_id string; claim_type string;
    service_date date; billed_amount money; allowed_amount money; paid_amount money;
    member_liability money; claim_status string; denial_reason string; drg_code string""")

DIAGNOSES = _schema("""
    patient_id string; icd10_code string; diagnosis_description string; onset_date date;
    charlson_weight int; hcc_flag int; clinical_status string""")

MEDICATIONS = _schema("""
    patient_id string; rx_id string; medication_name string; drug_class string; start_date date;
    days_supply int; refills int; adherence_pdc ratio; active_flag int""")

LABS = _schema("""
    patient_id string; loinc_code string; test_name string; unit string; result_value lab;
    ref_low lab; ref_high lab; abnormal_flag int; collected_date date""")

ED_VISITS = _schema("""
    patient_id string; ed_visit_date date; chief_complaint string; admitted_flag int""")

EXTRACTS: dict[str, T.StructType] = {
    "patients": PATIENTS, "members": MEMBERS, "encounters": ENCOUNTERS, "claims": CLAIMS,
    "diagnoses": DIAGNOSES, "medications": MEDICATIONS, "labs": LABS, "ed_visits": ED_VISITS}
