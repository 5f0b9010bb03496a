"""The registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panel360.operators import (
    audit,
    docs,
    evals,
    gaps,
    governance,
    index,
    ledger,
    names,
    quality,
    risk,
    rollups,
    search,
    sketches,
    vectors,
)
from panel360.plans import bindings, questions, semantic
from panel360.plans.panel import Panel
from panel360.sources.documents import parse_html
from panel360.sources.extracts import read_extract
from panel360.sources.literals import inline_rows
from panel360.sources.scratch import scratch, stored
from panel360.sources.tables import append_rows, audit_defaults, read_table, write_table

Query = Callable[[SparkSession, str], DataFrame]

PHRASES = (("L1", "Customer Building-000000005"), ("L2", "automobile patient in Asia"),
           ("L3", "SYN-P42"), ("L4", "machinery america age 40 F"))
NOTE_QUESTION = "barriers documented transportation cost caregiver"
POLICY_TYPES = ("UTILIZATION_POLICY", "REGULATORY_BULLETIN", "QUALITY_MEASURE")
QUERY_BOUND = 1000
COVERAGE_FLOOR = 0.35
ONE_PATIENT = "SYN-P42"


def _panel(make: Callable[[Panel], DataFrame]) -> Query:
    return lambda spark, folder: make(bindings.panel(spark, folder))


def _fact(name: str, make: Callable[[DataFrame], DataFrame]) -> Query:
    return _panel(lambda panel: make(panel.extracts[name]))


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# --- Scans and sinks -----------------------------------------------------------------------------

def csv_extract(panel: Panel) -> DataFrame:
    """The patients written as a CSV extract and read back with their schema."""
    patients = panel.extracts["patients"]
    path = scratch(patients.sparkSession, "csv")
    (patients.write.option("header", True).option("quote", '"').option("escape", '"').csv(path))
    return read_extract(patients.sparkSession, path, patients.schema)


def partitioned_table(panel: Panel) -> DataFrame:
    """The dimension written in folders by clinic and read back: patients by clinic."""
    dim = panel.dim_patient
    path = scratch(dim.sparkSession, "dim-by-clinic")
    write_table(dim, path, ("attributed_clinic",))
    return read_table(dim.sparkSession, path, dim.schema).groupBy("attributed_clinic").agg(
        F.count("*").alias("patients"), F.max("birth_date").alias("youngest"))


def appended_log(spark: SparkSession, folder: str) -> DataFrame:
    """The answer log appended in two parts, each given its own ids and askers."""
    log = bindings.audit_log(spark, folder).drop("audit_id", "asked_by")
    path = scratch(spark, "answer-log")
    for user, part in (("night", "hour(asked_at) < 12"),
                       ("day", "coalesce(hour(asked_at) >= 12, true)")):
        append_rows(log.filter(part), path, audit_defaults(user, "ANALYST"))
    return read_table(spark, path).groupBy("asked_by", "asked_role").agg(
        F.count("*").alias("answers"), F.count_distinct("audit_id").alias("ids"))


def distinct_estimates(panel: Panel) -> DataFrame:
    """Patients of each claim status: exact, and whether the estimate from sketches stored per status and
    month is within four standard errors."""
    claims = panel.extracts["claims"].withColumn("month", F.trunc("service_date", "month"))
    kept = stored(sketches.distinct_sketches(claims, ["claim_status", "month"], "patient_id"), "sketches")
    guess = sketches.distinct_estimates(kept, ["claim_status"])
    exact = claims.groupBy("claim_status").agg(F.count_distinct("patient_id").alias("patients"))
    far = F.abs(F.col("distinct_estimate") - F.col("patients")) / F.col("patients")
    return exact.join(guess, "claim_status").select(
        "claim_status", "patients", (far <= 4 * sketches.standard_error()).alias("close"))


# --- Quality -------------------------------------------------------------------------------------

def column_tests(panel: Panel) -> DataFrame:
    return quality.column_tests(panel.extracts["claims"], quality.ColumnTests(
        not_null=("claim_id", "denial_reason"), unique=("claim_id", "encounter_id"),
        accepted={"claim_status": ("PAID", "DENIED")},
        references={"patient_id": (panel.extracts["patients"], "patient_id")}))


# --- Retrieval -----------------------------------------------------------------------------------

def term_stats(spark: SparkSession, folder: str) -> DataFrame:
    return search.corpus_terms(bindings.table(spark, folder, "documents"), "text")


def bm25_topk(spark: SparkSession, folder: str, min_coverage: float = 0.0) -> DataFrame:
    return search.text_search(bindings.table(spark, folder, "documents"),
                              evals.golden_questions(spark), search.POLICY_K, "doc_id", "text",
                              min_coverage=min_coverage, max_queries=QUERY_BOUND)


def no_evidence(spark: SparkSession, folder: str) -> DataFrame:
    golden = evals.golden_questions(spark).select("qid", "question")
    return search.no_evidence(golden, bm25_topk(spark, folder, COVERAGE_FLOOR))


def _chunk_index(panel: Panel, scope: str) -> str:
    """A stored index over the chunks of one scope."""
    chunks = panel.chunks.filter(F.col("scope") == scope)
    path = scratch(chunks.sparkSession, f"index-{scope.lower()}")
    index.write_index(chunks, path, "citation_label", "chunk_text", index.INDEX_ATTRIBUTES)
    return path


def note_search(panel: Panel) -> DataFrame:
    """Every patient's own notes, searched for barriers: as many queries as patients."""
    asked = panel.dim_patient.select(F.col("patient_id").alias("qid"), "patient_id",
                                     F.lit(NOTE_QUESTION).alias("question"))
    return index.search_index(
        asked.sparkSession, _chunk_index(panel, "PATIENT_SPECIFIC"), asked, search.NOTES_K,
        "citation_label", "chunk_text", ("doc_id", "doc_type", "section_heading"),
        filters=("patient_id",)).select("qid", "citation_label", "doc_id", "doc_type",
                                        "section_heading", "chunk_text", "score", "coverage", "rank")


def policy_search(panel: Panel) -> DataFrame:
    """The golden questions put to institutional chunks, among all and within each document type."""
    spark = panel.metadata.sparkSession
    path = _chunk_index(panel, "INSTITUTIONAL")
    golden = evals.golden_questions(spark).select("qid", "question")
    narrowed = golden.select("qid", "question", F.explode(F.array(
        *map(F.lit, POLICY_TYPES))).alias("doc_type")).withColumn(
        "qid", F.concat_ws("/", "qid", "doc_type"))
    shown = ("qid", "citation_label", "doc_id", "doc_type", "section_heading", "chunk_text",
             "score", "coverage", "rank")
    attributes = ("doc_id", "doc_type", "section_heading")
    every = index.search_index(spark, path, golden, search.POLICY_K, "citation_label", "chunk_text",
                               attributes)
    by_type = index.search_index(spark, path, narrowed, search.POLICY_K, "citation_label",
                                 "chunk_text", attributes, filters=("doc_type",))
    return every.select(*shown).unionByName(by_type.select(*shown))


def revised_index(spark: SparkSession, folder: str) -> str:
    """An index of the documents in two segments. Those in other languages than English come first with
    their language's name for a text and are revised by the second segment."""
    path = scratch(spark, "index-documents")
    texts = bindings.table(spark, folder, "documents").select(
        "doc_id", "text", "lang", F.coalesce(F.col("lang") != "en", F.lit(True)).alias("revised"))
    index.write_index(texts.select("doc_id", F.when(F.col("revised"), F.col("lang")).otherwise(
        F.col("text")).alias("text")), path, "doc_id", "text")
    later = texts.filter("revised")
    index.write_segment(later.select("doc_id", "text"), path, 1, "doc_id", "text",
                        dead=later.select("doc_id", F.lit(0).alias("of")))
    index.commit(spark, path, 1)
    return path


def similar_documents(spark: SparkSession, folder: str) -> DataFrame:
    """For every document whose id is divisible by 50, the documents that its most distinctive terms
    find, over an index with a revision."""
    path = revised_index(spark, folder)
    asked = stored(index.distinctive_terms(spark, path, "doc_id", F.col("doc_id") % 50 == 0), "asked")
    return index.search_index(spark, path, asked, search.POLICY_K, "doc_id", "text", bounded=True).drop("text")


def text_search_all(spark: SparkSession, folder: str) -> DataFrame:
    """The golden questions over documents, by the plan for any number of queries."""
    return search.text_search(bindings.table(spark, folder, "documents"),
                              evals.golden_questions(spark), search.POLICY_K, "doc_id", "text")


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """For every label, the vectors of that label nearest its mean, for any number of labels."""
    asked = bindings.centroids(spark, folder).withColumn("qid", F.col("label"))
    return search.vector_search(bindings.table(spark, folder, "embeddings"), asked, search.POLICY_K,
                                "vec_id", "embedding", filters=("label",))


def vector_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """For every vector whose id is divisible by 50, the nearest of all vectors."""
    every = bindings.table(spark, folder, "embeddings")
    asked = every.filter(F.col("vec_id") % 50 == 0).select(
        F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vector"))
    return vectors.nearest(every, asked, search.POLICY_K, "vec_id", "embedding")


def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Golden questions with a label's mean as their vector: text and vector lists fused."""
    label = (F.substr("qid", F.lit(2)).cast("int") - 1) % 10
    vectors = (evals.golden_questions(spark).select("qid", label.alias("label"))
               .join(bindings.centroids(spark, folder), "label"))
    by_vector = search.vector_scan(
        bindings.table(spark, folder, "embeddings").withColumnRenamed("vec_id", "doc_id"),
        vectors, search.POLICY_K, "doc_id", "embedding", max_queries=QUERY_BOUND)
    return search.fuse([bm25_topk(spark, folder), by_vector], search.POLICY_K, "doc_id")


def patient_lookup(spark: SparkSession, folder: str) -> DataFrame:
    schema = T.StructType([T.StructField("qid", T.StringType()),
                           T.StructField("phrase", T.StringType())])
    return search.patient_lookup(bindings.panel(spark, folder).dim_patient,
                                 inline_rows(spark, schema, PHRASES), max_queries=QUERY_BOUND)


def name_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Every patient whose number is divisible by 50, asked for by the beginning of the first name and
    a last name with its last sign but one wrong, among all patients."""
    dim = bindings.panel(spark, folder).dim_patient.select("patient_id", "full_name", "first_name", "last_name")
    path = scratch(spark, "names")
    names.write_names(dim, path)
    number = F.substr("patient_id", F.lit(6)).cast("long")
    wrong = F.overlay("last_name", F.lit("x"), F.length("last_name") - 1, F.lit(1))
    asked = stored(dim.filter(number % 50 == 0).select(F.col("patient_id").alias("qid"), F.concat(
        F.left("first_name", F.lit(4)), F.lit(" "), wrong).alias("phrase")), "phrases")
    return names.find_names(spark, path, asked, search.LOOKUP_K)


def sv_terms(spark: SparkSession, folder: str) -> DataFrame:
    asked = (bindings.audit_log(spark, folder).groupBy(F.col("question").alias("term"))
             .agg(F.count("*").alias("times_asked")))
    return semantic.resolve_terms(asked, semantic.term_table(spark))


# --- Governance ----------------------------------------------------------------------------------

def _by_role(spark: SparkSession, make: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    granted = governance.entitlement_table(spark, bindings.CLINIC_ENTITLEMENTS)
    return _union([make(role, granted).withColumn("role", F.lit(role))
                   for role in governance.ROLES])


def row_access(spark: SparkSession, folder: str) -> DataFrame:
    dim = bindings.panel(spark, folder).dim_patient
    return _by_role(spark, lambda role, granted: governance.row_access(dim, role, granted)
                    .groupBy("attributed_clinic").agg(F.count("*").alias("patients")))


def masked_panel(spark: SparkSession, folder: str) -> DataFrame:
    dim = governance.tag_columns(bindings.panel(spark, folder).dim_patient)
    return _by_role(spark, lambda role, granted: governance.secure_view(dim, role, granted).select(
        "patient_id", "full_name", "first_name", "last_name", "birth_date", "postal_code",
        "attributed_clinic"))


def _secured(table: Callable[[Panel], DataFrame], *columns: str) -> Query:
    """A table as every role sees it, built once."""
    def make(spark: SparkSession, folder: str) -> DataFrame:
        panel = bindings.panel(spark, folder)
        granted = governance.entitlement_table(spark, bindings.CLINIC_ENTITLEMENTS)
        return governance.secure_by_role(governance.tag_columns(table(panel)), granted,
                                         panel.dim_patient).select("role", *columns)
    return make


# --- Evaluation ----------------------------------------------------------------------------------

def golden_class_counts(spark: SparkSession, folder: str) -> DataFrame:
    return evals.class_counts(evals.golden_questions(spark), bindings.eval_runs(spark, folder))


def eval_routing(spark: SparkSession, folder: str) -> DataFrame:
    return evals.routing(bindings.eval_runs(spark, folder), evals.golden_questions(spark)).select(
        "run_id", "qid", "question_class", "run_at", "latency_ms", "tools_matched",
        "tools_expected", "citation_count")


def judge_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return evals.judge_prompts(bindings.eval_runs(spark, folder),
                               evals.golden_questions(spark)).select("run_id", "qid",
                                                                     "judge_prompt")


def judge_scores(spark: SparkSession, folder: str) -> DataFrame:
    return evals.judge_scores(bindings.eval_runs(spark, folder)).select(
        "run_id", "qid", "latency_ms", *evals.AXES)


def eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evals.run_summary(evals.judge_scores(evals.routing(
        bindings.eval_runs(spark, folder), evals.golden_questions(spark))))


def citation_audit(spark: SparkSession, folder: str) -> DataFrame:
    panel = bindings.panel(spark, folder)
    return evals.citation_audit_of(bindings.eval_runs(spark, folder), panel.metadata, panel.p360,
                                   panel.extracts["claims"])


QUERIES: dict[str, Query] = {
    "html_title_scan": lambda spark, folder: parse_html(bindings.table(spark, folder, "pages")),
    "csv_extract": _panel(csv_extract),
    "partitioned_table": _panel(partitioned_table),
    "appended_log": appended_log,
    "fact_claims": _fact("claims", lambda claims: claims),
    "ed_visits": _fact("ed_visits", lambda visits: visits.groupBy("patient_id").agg(
        F.count("*").alias("visits"), F.sum("admitted_flag").alias("admitted"),
        F.max("ed_visit_date").alias("last_visit"))),
    "distinct_estimates": _panel(distinct_estimates),
    "dim_patient": _panel(lambda p: p.dim_patient),
    "patient_utilization": _panel(lambda p: rollups.patient_utilization(
        p.extracts["encounters"], p.as_of)),
    "last_admission": _fact("encounters", rollups.last_admission),
    "patient_burden": _fact("diagnoses", rollups.patient_burden),
    "patient_pharmacy": _fact("medications", rollups.patient_pharmacy),
    "patient_labs": _fact("labs", rollups.patient_labs),
    "newest_labs": _fact("labs", rollups.latest_results),
    "patient_financial": _fact("claims", rollups.patient_financial),
    "patient_signals": _panel(lambda p: rollups.patient_signals(p.signals)),
    "patient_360": _panel(lambda p: p.p360),
    "member_360": _panel(lambda p: p.member_360),
    "lace_points": _panel(lambda p: risk.points(p.p360).select(
        "patient_id", *questions.COMPONENT_COLUMNS, "lace_index")),
    "risk_readmission": _panel(lambda p: p.risk),
    "risk_explanation": _panel(lambda p: p.risk.select(
        "patient_id", "score_explanation", "methodology_citation")),
    "score_components": _panel(lambda p: risk.score_components(p.risk)),
    "risk_band_distribution": _panel(questions.risk_band_distribution),
    "band_calibration": _panel(lambda p: risk.band_calibration(
        p.risk, rollups.index_outcomes(p.extracts["encounters"]))),
    "care_gaps": _panel(lambda p: p.gaps),
    "patient_gap_counts": _panel(lambda p: gaps.gap_counts(p.p360)),
    "gaps_by_document": _panel(lambda p: gaps.gaps_by_document(p.gaps)),
    "dq_checks": _panel(lambda p: p.dq_checks),
    "dq_gate": _panel(lambda p: quality.dq_gate(p.dq_checks)),
    "column_tests": _panel(column_tests),
    "identifier_scan": lambda spark, folder: quality.identifier_scan(
        bindings.table(spark, folder, "documents"), ["text"]),
    "doc_metadata": _panel(lambda p: p.metadata),
    "doc_chunks": _panel(lambda p: p.chunks),
    "citation_labels": _panel(lambda p: p.chunks.select(
        "doc_id", "chunk_index", "section_heading", "citation_label")),
    "doc_signals": _panel(lambda p: docs.doc_signals(p.metadata)),
    "safety_flags": _panel(lambda p: p.signals),
    "doc_type_summary": _panel(lambda p: docs.doc_type_summary(p.chunks)),
    "linked_documents": _panel(lambda p: docs.linked_documents(p.chunks)),
    "evidence_ledger": _panel(lambda p: p.ledger),
    "evidence_pack": _panel(lambda p: ledger.evidence_packs(p.ledger)),
    "one_evidence_pack": _panel(lambda p: ledger.evidence_pack(p.ledger, ONE_PATIENT, limit=None)),
    "patient_profile": _panel(lambda p: questions.patient_profile(p, ONE_PATIENT).select(
        "patient_id", "full_name", "attributed_clinic", "lace_index", "adjusted_score", "risk_band",
        "score_explanation", F.col("open_gaps").cast("long").alias("open_gaps"))),
    "full_record_top_risk": _panel(questions.full_record_top_risk),
    "kpi_strip": _panel(questions.kpi_strip),
    "object_counts": _panel(questions.object_counts),
    "risk_roster": _panel(questions.risk_roster),
    "active_medications": _panel(questions.active_medications),
    "recent_labs": _panel(questions.recent_labs),
    "lab_pivot": _panel(lambda p: questions.lab_pivot(p, bindings.TEST_NAMES)),
    "clinic_risk": _panel(questions.clinic_risk),
    "clinic_gaps": _panel(questions.clinic_gaps),
    "top_risk_at_clinic": _panel(questions.top_risk_at_clinic),
    "latest_admission_summary": _panel(questions.latest_admission_summary),
    "clinic_comparison": _panel(lambda p: questions.clinic_comparison(p, ["AFRICA", "AMERICA"])),
    "chf_no_gdmt_cohort": _panel(lambda p: questions.gap_cohort(p, "CHF_NO_GDMT_ON_FILE")),
    "step_therapy_failures": _panel(questions.step_therapy_failures),
    "high_utilizers": _panel(lambda p: questions.high_utilizers(p, more_than=1)),
    "potassium_on_arni_mra": _panel(questions.potassium_on_arni_mra),
    "clinic_readmit_drivers": _panel(questions.clinic_readmit_drivers),
    "gaps_by_lob": _panel(questions.gaps_by_lob),
    "age_band_mix": _panel(questions.age_band_mix),
    "sv_clinic_band": _panel(questions.sv_clinic_band),
    "sv_high_risk_share": _panel(questions.sv_high_risk_share),
    "sv_high_risk_panel": _panel(questions.sv_high_risk_panel),
    "sv_readmit_by_clinic": _panel(questions.sv_readmit_by_clinic),
    "sv_gaps_by_lob": _panel(questions.sv_gaps_by_lob),
    "sv_denial_reasons": _panel(questions.sv_denial_reasons),
    "sv_scoreboard": _panel(questions.sv_scoreboard),
    "sv_terms": sv_terms,
    "term_stats": term_stats,
    "bm25_topk": bm25_topk,
    "no_evidence": no_evidence,
    "note_search": _panel(note_search),
    "policy_search": _panel(policy_search),
    "text_search": text_search_all,
    "similar_documents": similar_documents,
    "vector_topk": vector_topk,
    "vector_neighbours": vector_neighbours,
    "hybrid_topk": hybrid_topk,
    "patient_lookup": patient_lookup,
    "name_lookup": name_lookup,
    "row_access": row_access,
    "masked_panel": masked_panel,
    "masked_chunks": _secured(lambda p: p.chunks, "citation_label", "file_name", "chunk_text"),
    "masked_360": _secured(lambda p: p.p360, "patient_id", "full_name", "birth_date",
                           "attributed_clinic", "barrier_to_care", "documented_adverse_event"),
    "masked_risk": _secured(lambda p: p.risk, "patient_id", "attributed_clinic", "lace_index",
                            "score_explanation"),
    "masked_ledger": _secured(lambda p: p.placed_ledger, "evidence_class", "source_id", "locator",
                              "patient_id", "source_type", "evidence_text"),
    "grounding_scorecard": lambda spark, folder: audit.grounding_scorecard(
        bindings.audit_log(spark, folder)),
    "scorecard_daily": lambda spark, folder: audit.scorecard_daily(
        bindings.audit_log(spark, folder)),
    "golden_class_counts": golden_class_counts,
    "eval_routing": eval_routing,
    "judge_prompts": judge_prompts,
    "judge_scores": judge_scores,
    "eval_summary": eval_summary,
    "citation_audit": citation_audit}
