"""The governed model: entities, relationships, facts, dimensions and metrics. All names, synonyms
and expressions below are fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Entity:
    """`carries` names dimensions of its parent that the entity's own rows hold as well."""

    name: str
    table: str
    primary_key: str | None
    synonyms: tuple[str, ...] = ()
    carries: tuple[str, ...] = ()


@dataclass(frozen=True)
class Relationship:
    """Many-to-one from `child` to `parent` on `key`; one-to-one where the key is the child's
    primary key too."""

    child: str
    parent: str
    key: str


@dataclass(frozen=True)
class Dimension:
    entity: str
    name: str
    synonyms: tuple[str, ...] = ()
    expr: str | None = None

    @property
    def sql(self) -> str:
        return self.expr or self.name


@dataclass(frozen=True)
class Measure:
    """A sum, a row count or a distinct count, optionally over the rows where `when` holds."""

    kind: str
    expr: str = "1"
    when: str | None = None

    @property
    def sql(self) -> str:
        return f"CASE WHEN {self.when} THEN {self.expr} END" if self.when else self.expr


@dataclass(frozen=True)
class Metric:
    """A measure, or a quotient of two: a mean is NULL over no rows, a rate is 0."""

    entity: str
    name: str
    numerator: Measure
    denominator: Measure | None = None
    zero_safe: bool = True
    synonyms: tuple[str, ...] = ()


def _sum(expr: str) -> Measure:
    return Measure("sum", expr)


def _mean(entity: str, name: str, expr: str, *synonyms: str) -> Metric:
    return Metric(entity, name, _sum(expr), Measure("count", expr), False, synonyms)


def _distinct(expr: str, when: str | None = None) -> Measure:
    return Measure("distinct", expr, when)


ENTITIES = (
    Entity("patient", "patient_360", "patient_id",
           ("patients", "people", "panel", "member roster", "patient 360")),
    Entity("member", "member_360", "member_id",
           ("members", "enrollees", "coverage", "plan membership")),
    Entity("risk", "risk_readmission", "patient_id",
           ("risk", "readmission risk", "risk stratification", "LACE", "risk tier")),
    Entity("gaps", "care_gap", None, ("care gaps", "gaps in care", "quality gaps", "open gaps"),
           carries=("attributed_clinic", "line_of_business")),
    Entity("enc", "fact_encounter", "encounter_id",
           ("encounters", "visits", "admissions", "stays")),
    Entity("clm", "fact_claim", "claim_id", ("claims", "billing", "remittance")),
    Entity("dx", "fact_diagnosis", None, ("diagnoses", "conditions", "problems", "problem list")),
    Entity("rx", "fact_medication", None, ("medications", "drugs", "prescriptions", "pharmacy")))

RELATIONSHIPS = tuple(Relationship(child, "patient", "patient_id")
                      for child in ("member", "risk", "gaps", "enc", "clm", "dx", "rx"))

FACTS = {
    "patient": ("age_years", "ed_visits_6mo", "charlson_raw", "total_allowed_amount",
                "total_paid_amount", "denied_claim_count", "claim_count", "worst_pdc",
                "latest_a1c", "latest_potassium", "any_readmit_30d"),
    "risk": ("lace_index", "adjusted_score", "l_points", "a_points", "c_points", "e_points"),
    "enc": ("length_of_stay_days", "readmit_30d"),
    "clm": ("allowed_amount", "paid_amount", "member_liability"),
    "rx": ("adherence_pdc",),
    "dx": ("charlson_weight",)}

AGE_BAND = "CASE WHEN age_years < 45 THEN '19-44' WHEN age_years < 65 THEN '45-64' ELSE '65+' END"

DIMENSIONS = (
    Dimension("patient", "patient_id", ("patient identifier", "mrn")),
    Dimension("patient", "full_name", ("name", "patient name")),
    Dimension("patient", "sex", ("gender",)),
    Dimension("patient", "state", ("province", "region")),
    Dimension("patient", "attributed_clinic", ("clinic", "site", "practice", "panel", "location")),
    Dimension("patient", "line_of_business",
              ("LOB", "product", "coverage type", "commercial medicare medicaid")),
    Dimension("patient", "payer_name", ("payer", "plan sponsor", "insurer")),
    Dimension("patient", "plan_id", ("plan", "benefit plan")),
    Dimension("patient", "risk_program", ("program", "care management program")),
    Dimension("patient", "primary_language", ("language",)),
    Dimension("patient", "age_band", ("age group", "age bracket", "age cohort"), AGE_BAND),
    Dimension("patient", "has_chf", ("heart failure", "CHF", "congestive heart failure")),
    Dimension("patient", "has_t2dm", ("diabetes", "type 2 diabetes", "T2DM")),
    Dimension("patient", "has_ckd", ("kidney disease", "CKD", "renal disease")),
    Dimension("patient", "has_copd", ("COPD", "chronic lung disease")),
    Dimension("patient", "on_arni", ("ARNI", "sacubitril valsartan", "entresto-like")),
    Dimension("patient", "on_mra", ("MRA", "spironolactone", "aldosterone antagonist")),
    Dimension("patient", "on_sglt2", ("SGLT2", "SGLT2 inhibitor", "flozin")),
    Dimension("patient", "on_metformin", ("metformin", "biguanide")),
    Dimension("patient", "documented_barrier_to_care",
              ("barrier", "social barrier", "SDOH barrier")),
    Dimension("risk", "risk_band",
              ("risk tier", "risk level", "risk category", "acuity", "stratification")),
    Dimension("risk", "score_explanation",
              ("why", "explanation", "risk reason", "rationale", "breakdown")),
    Dimension("risk", "methodology_citation",
              ("methodology", "citation", "basis", "source of the score")),
    Dimension("gaps", "gap_type", ("gap", "gap category", "measure")),
    Dimension("gaps", "gap_detail", ("gap description",)),
    Dimension("gaps", "governing_document_id",
              ("policy", "governing policy", "which document", "specification")),
    Dimension("gaps", "gap_status"),
    Dimension("enc", "encounter_type", ("visit type", "setting", "care setting")),
    Dimension("enc", "admission_source", ("acuity", "how admitted", "admit source")),
    Dimension("enc", "discharge_disposition", ("discharged to", "disposition")),
    Dimension("enc", "facility", ("hospital", "site of care")),
    Dimension("clm", "claim_status", ("status", "paid denied pending")),
    Dimension("clm", "denial_reason", ("why denied", "denial", "rejection reason")),
    Dimension("clm", "claim_type", ("facility or professional",)),
    Dimension("dx", "icd10_code", ("diagnosis code", "ICD", "ICD-10")),
    Dimension("dx", "diagnosis_description", ("condition name", "diagnosis")),
    Dimension("rx", "drug_class", ("medication class", "therapeutic class")),
    Dimension("rx", "medication_name", ("drug", "medication")))

METRICS = (
    Metric("patient", "patient_count", _distinct("patient_id"),
           synonyms=("patients", "how many patients", "headcount", "panel size")),
    _mean("patient", "avg_age", "age_years", "average age", "mean age"),
    Metric("patient", "total_cost", _sum("total_allowed_amount"),
           synonyms=("cost", "spend", "total allowed", "allowed spend")),
    Metric("patient", "cost_per_patient", _sum("total_allowed_amount"), _distinct("patient_id"),
           synonyms=("cost per patient", "PMPY", "average cost")),
    Metric("patient", "readmission_rate", _sum("any_readmit_30d"), _distinct("patient_id"),
           synonyms=("readmission rate", "30 day readmission rate", "readmit rate")),
    _mean("patient", "avg_worst_pdc", "worst_pdc", "adherence", "average PDC",
          "medication adherence"),
    _mean("risk", "avg_lace_index", "lace_index", "average risk score", "mean LACE",
          "average LACE index"),
    Metric("risk", "high_risk_count", _distinct("patient_id", "risk_band = 'HIGH'"),
           synonyms=("high risk patients", "number at high risk")),
    Metric("risk", "high_risk_share", _distinct("patient_id", "risk_band = 'HIGH'"),
           _distinct("patient_id"), synonyms=("percent high risk", "share high risk")),
    Metric("gaps", "open_gap_count", Measure("count"),
           synonyms=("gaps", "number of gaps", "open gaps")),
    Metric("gaps", "patients_with_gaps", _distinct("patient_id"),
           synonyms=("patients with a gap", "how many have gaps")),
    Metric("enc", "encounter_total", _distinct("encounter_id"),
           synonyms=("visits", "encounters")),
    _mean("enc", "avg_length_of_stay", "length_of_stay_days", "ALOS", "average LOS",
          "length of stay"),
    Metric("clm", "total_allowed", _sum("allowed_amount"),
           synonyms=("allowed amount", "total allowed")),
    Metric("clm", "total_paid", _sum("paid_amount"), synonyms=("paid", "total paid")),
    Metric("clm", "denial_rate", Measure("count", "1", "claim_status = 'DENIED'"),
           Measure("count"), synonyms=("denial rate", "percent denied", "rejection rate")))

# What must accompany a value: a score brings its arithmetic where the grain is one patient, a gap
# brings the document that defines it.
COMPANIONS = {"risk_band": ("score_explanation", "patient_id"),
              "avg_lace_index": ("score_explanation", "patient_id"),
              "gap_type": ("governing_document_id", None)}


@dataclass(frozen=True)
class SemanticModel:
    entities: tuple[Entity, ...] = ENTITIES
    relationships: tuple[Relationship, ...] = RELATIONSHIPS
    facts: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(FACTS))
    dimensions: tuple[Dimension, ...] = DIMENSIONS
    metrics: tuple[Metric, ...] = METRICS


MODEL = SemanticModel()
