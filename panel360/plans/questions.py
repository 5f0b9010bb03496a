"""Named questions: dashboard queries and the copilot's data questions, each one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panel360.operators import gaps, ledger, risk
from panel360.operators.risk import explanation, points
from panel360.plans.panel import Panel
from panel360.plans.semantic import semantic_query

ROSTER_SIZE = 60
RECENT_LABS = 12
COMPONENT_COLUMNS = ("l_points", "a_points", "c_points", "e_points", "mod_adherence_point",
                     "mod_barrier_point")


# --- Dashboard -----------------------------------------------------------------------------------

def kpi_strip(panel: Panel) -> DataFrame:
    """Five headline numbers as one row. Patients, gaps and the mean come from one pass over the
    360; the two other counts are scalar subqueries."""
    encounters = panel.extracts["encounters"].select(F.count("*")).scalar()
    documents = panel.metadata.select(F.count_distinct("doc_id")).scalar()
    return points(panel.p360).agg(
        F.count("*").alias("patients"), encounters.alias("encounters"),
        documents.alias("documents"),
        F.sum(F.size(gaps.gap_array())).alias("open_gaps"),
        F.round(F.avg(F.col("lace_index").cast("double")), 1).alias("avg_lace"))


def object_counts(panel: Panel) -> DataFrame:
    counted = (("Patients", panel.p360, F.count("*")),
               ("Encounters", panel.extracts["encounters"], F.count("*")),
               ("Claims", panel.extracts["claims"], F.count("*")),
               ("Documents", panel.metadata, F.count_distinct("doc_id")),
               ("Document chunks", panel.chunks, F.count("*")))
    rows = [df.agg(n.alias("n")).select(F.lit(name).alias("object"), "n")
            for name, df, n in counted]
    result = rows[0]
    for row in rows[1:]:
        result = result.unionByName(row)
    return result


def risk_roster(panel: Panel, size: int = ROSTER_SIZE) -> DataFrame:
    """The patients of highest adjusted score."""
    return (points(panel.p360)
            .select("patient_id", "full_name", "risk_band", "lace_index", "adjusted_score",
                    "attributed_clinic")
            .orderBy(F.desc("adjusted_score"), F.desc("lace_index"), F.asc("patient_id"))
            .limit(size))


def patient_profile(panel: Panel, patient_id: str) -> DataFrame:
    """360 row, score and open-gap count of one patient; the id filter reaches every scan."""
    one = panel.p360.filter(F.col("patient_id") == F.lit(patient_id))
    return points(one).withColumns({"score_explanation": explanation(),
                                    "open_gaps": F.size(gaps.gap_array())})


def active_medications(panel: Panel) -> DataFrame:
    return panel.extracts["medications"].filter("active_flag = 1").select(
        "patient_id", "medication_name", "drug_class", "adherence_pdc", "days_supply")


def recent_labs(panel: Panel, limit: int = RECENT_LABS) -> DataFrame:
    """The latest results of every patient."""
    newest = Window.partitionBy("patient_id").orderBy(
        F.desc("collected_date"), F.asc("test_name"), F.desc("result_value"))
    return (panel.extracts["labs"].withColumn("row_in_patient", F.row_number().over(newest))
            .filter(F.col("row_in_patient") <= limit)
            .select("patient_id", "row_in_patient", "collected_date", "test_name", "result_value",
                    "unit", "ref_low", "ref_high", "abnormal_flag"))


def lab_pivot(panel: Panel, tests: Sequence[str]) -> DataFrame:
    """Mean result by patient, date and test, one column per test. The tests are named by the
    caller, so no job runs to discover them."""
    value = F.col("result_value").cast("double")
    wide = (panel.extracts["labs"].groupBy("patient_id", "collected_date")
            .pivot("test_name", list(tests)).agg(F.round(F.avg(value), 4)))
    names = {test: "".join(c if c.isalnum() else "_" for c in test.lower()) for test in tests}
    return wide.select("patient_id", "collected_date",
                       *[F.col(f"`{test}`").alias(name) for test, name in names.items()])


def clinic_risk(panel: Panel) -> DataFrame:
    return panel.risk.groupBy("attributed_clinic").agg(
        F.count("patient_id").alias("total_patients"),
        F.round(F.avg(F.col("adjusted_score").cast("double")), 2).alias("avg_risk_score"))


def clinic_gaps(panel: Panel) -> DataFrame:
    """Open gaps per clinic; a clinic without any has no row. Gap rows already carry the clinic
    they would be joined to."""
    return panel.gaps.groupBy("attributed_clinic").agg(
        F.count("gap_type").alias("total_open_gaps"))


# --- Copilot questions ---------------------------------------------------------------------------

def top_risk_at_clinic(panel: Panel) -> DataFrame:
    """The highest-risk patient of every clinic, with the components."""
    best = Window.partitionBy("attributed_clinic").orderBy(
        F.desc("adjusted_score"), F.desc("lace_index"), F.asc("patient_id"))
    return (panel.risk.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1")
            .select("attributed_clinic", "patient_id", "lace_index", "adjusted_score",
                    *COMPONENT_COLUMNS, "score_explanation"))


def latest_admission_summary(panel: Panel) -> DataFrame:
    """The most recently admitted patient with score and open gaps."""
    newest = (panel.extracts["encounters"].filter("encounter_type = 'INPATIENT'")
              .orderBy(F.desc_nulls_last("start_date"), F.desc("encounter_id")).limit(1)
              .select("patient_id", "encounter_id", "start_date"))
    open_gaps = F.array_sort(F.transform(gaps.gap_array(), lambda gap: gap["gap_type"]))
    scored = points(panel.p360).select(
        "patient_id", "full_name", "lace_index", "risk_band",
        explanation().alias("score_explanation"), F.array_join(open_gaps, ", ").alias("gap_types"))
    return scored.join(newest, "patient_id")


def clinic_comparison(panel: Panel, clinics: Sequence[str]) -> DataFrame:
    return semantic_query(panel.semantic_tables, ["attributed_clinic"],
                          ["avg_lace_index", "open_gap_count"],
                          where={"attributed_clinic": list(clinics)})


def gap_cohort(panel: Panel, gap_type: str) -> DataFrame:
    """The patients with one kind of gap, their score, and the governing document."""
    rule = next(r for r in gaps.RULES if r.gap_type == gap_type)
    return points(panel.p360.filter(rule.predicate)).select(
        "patient_id", "attributed_clinic", "lace_index", "risk_band", *COMPONENT_COLUMNS,
        explanation().alias("score_explanation"),
        F.lit(rule.document).alias("governing_document_id"))


def step_therapy_failures(panel: Panel) -> DataFrame:
    """Diabetic patients without metformin on file, who fail the step before an SGLT2 inhibitor."""
    return panel.p360.filter("has_t2dm AND NOT on_metformin").select(
        "patient_id", "attributed_clinic", "on_sglt2", "latest_a1c")


def high_utilizers(panel: Panel, more_than: int = 3, months: int = 12) -> DataFrame:
    """Patients with more inpatient stays than that in the period, and their active diagnoses.
    Diagnoses are reduced to distinct codes before they are gathered, so a gathered list is no
    longer than the code list."""
    since = F.add_months(F.lit(panel.as_of), -months)
    heavy = (panel.extracts["encounters"]
             .filter((F.col("encounter_type") == "INPATIENT") & (F.col("start_date") >= since))
             .groupBy("patient_id").agg(F.count("*").alias("inpatient_stays"))
             .filter(F.col("inpatient_stays") > more_than))
    codes = (panel.extracts["diagnoses"].filter("clinical_status = 'active'")
             .select("patient_id", "icd10_code").distinct()
             .groupBy("patient_id").agg(F.array_join(F.array_sort(
                 F.collect_list("icd10_code")), ", ").alias("diagnoses")))
    return heavy.join(codes, "patient_id", "left")


def potassium_on_arni_mra(panel: Panel) -> DataFrame:
    return panel.p360.filter("latest_potassium > 5.4 AND (on_arni OR on_mra)").select(
        "patient_id", "attributed_clinic", "latest_potassium", "on_arni", "on_mra")


def full_record_top_risk(panel: Panel) -> DataFrame:
    """Everything on record about the patient with the highest adjusted score. The patient is a scalar
    subquery, which reaches the scans below every branch of the ledger."""
    top = risk_roster(panel, 1).select("patient_id").scalar()
    return ledger.evidence_packs(panel.ledger.filter(F.col("patient_id") == top), limit=None)


def clinic_readmit_drivers(panel: Panel) -> DataFrame:
    """Readmission rate by clinic beside the mean acuity and comorbidity points, worst first."""
    return (points(panel.p360).groupBy("attributed_clinic").agg(
        F.count("*").alias("patients"),
        F.round(F.avg(F.col("any_readmit_30d").cast("double")), 4).alias("readmission_rate"),
        F.round(F.avg(F.col("a_points").cast("double")), 4).alias("avg_a_points"),
        F.round(F.avg(F.col("c_points").cast("double")), 4).alias("avg_c_points"))
        .orderBy(F.desc("readmission_rate"), F.asc("attributed_clinic")))


# --- Verified semantic queries -------------------------------------------------------------------

def sv_high_risk_panel(panel: Panel) -> DataFrame:
    """Which patients are high risk, and why?"""
    return semantic_query(
        panel.semantic_tables,
        ["risk.patient_id", "risk.risk_band", "risk.score_explanation",
         "patient.attributed_clinic"], ["risk.avg_lace_index"], where={"risk_band": "HIGH"},
        order_by=[("avg_lace_index", "desc"), ("patient_id", "asc")])


def sv_readmit_by_clinic(panel: Panel) -> DataFrame:
    """What is the 30-day readmission rate by clinic?"""
    return semantic_query(panel.semantic_tables, ["patient.attributed_clinic"],
                          ["patient.patient_count", "patient.readmission_rate"],
                          order_by=[("readmission_rate", "desc")])


def sv_gaps_by_lob(panel: Panel) -> DataFrame:
    """How many open gaps are there by line of business and type?"""
    return semantic_query(panel.semantic_tables, ["patient.line_of_business", "gaps.gap_type"],
                          ["gaps.open_gap_count"], order_by=[("open_gap_count", "desc")],
                          companions=True)


def sv_denial_reasons(panel: Panel) -> DataFrame:
    """What are the most common denial reasons? Reasons are filed whatever the status, so paid
    claims count in the divisor."""
    return semantic_query(panel.semantic_tables, ["clm.denial_reason"],
                          ["clm.denial_rate", "clm.total_allowed"],
                          order_by=[("denial_rate", "desc")])


def sv_clinic_band(panel: Panel) -> DataFrame:
    """Patients and mean index by clinic and band: metrics of two entities side by side."""
    return semantic_query(panel.semantic_tables, ["attributed_clinic", "risk_band"],
                          ["patient_count", "avg_lace_index"],
                          order_by=[("attributed_clinic", "asc"), ("risk_band", "asc")])


def sv_scoreboard(panel: Panel) -> DataFrame:
    """All sixteen metrics by clinic, each at its own grain."""
    return semantic_query(
        panel.semantic_tables, ["attributed_clinic"],
        ["patient_count", "avg_age", "total_cost", "cost_per_patient", "readmission_rate",
         "avg_worst_pdc", "avg_lace_index", "high_risk_count", "high_risk_share",
         "open_gap_count", "patients_with_gaps", "encounter_total", "avg_length_of_stay",
         "total_allowed", "total_paid", "denial_rate"])


def age_band_mix(panel: Panel) -> DataFrame:
    return semantic_query(panel.semantic_tables, ["age_band"], ["patient_count", "avg_age"])


def sv_high_risk_share(panel: Panel) -> DataFrame:
    return semantic_query(panel.semantic_tables, ["line_of_business"],
                          ["high_risk_count", "high_risk_share"])


def gaps_by_lob(panel: Panel) -> DataFrame:
    """Open gaps by line of business and type with the governing document, from the gap rows."""
    return panel.gaps.groupBy("line_of_business", "gap_type", "governing_document_id").agg(
        F.count("*").alias("open_gaps"), F.count_distinct("patient_id").alias("patients"))


def risk_band_distribution(panel: Panel) -> DataFrame:
    return risk.band_distribution(panel.risk)
