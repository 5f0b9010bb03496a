"""Conformed patient dimension."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panel360.functions import initcap_punct, year_boundaries
from panel360.operators.joins import left_join


def dim_patient(patients: DataFrame, members: DataFrame, as_of: dt.date) -> DataFrame:
    """Patients with their coverage. Members are unique per member_id, so nothing fans out. Patients
    without a member id are spread over the join's tasks."""
    coverage = members.select("member_id", "payer_name", "plan_id", "line_of_business",
                              "risk_program", "attributed_clinic", "enroll_start")
    return left_join(patients, coverage, "member_id").select(
        "patient_id", "member_id", "first_name", "last_name",
        initcap_punct(F.concat("first_name", F.lit(" "), "last_name")).alias("full_name"),
        "birth_date", year_boundaries(F.col("birth_date"), F.lit(as_of)).alias("age_years"),
        "sex", "city", "state", "postal_code", "primary_language", "pcp_npi",
        "payer_name", "plan_id", "line_of_business", "risk_program", "attributed_clinic",
        "enroll_start", "data_source")
