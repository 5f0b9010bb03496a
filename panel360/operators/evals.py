"""Evaluation of logged answers against golden questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panel360.functions import div0
from panel360.operators.ledger import held_labels
from panel360.sources.literals import inline_rows
from panel360.sources.scratch import stored

GOLDEN_SCHEMA = T.StructType([
    T.StructField("qid", T.StringType()), T.StructField("question", T.StringType()),
    T.StructField("question_class", T.StringType()),
    T.StructField("expected_tools", T.ArrayType(T.StringType())),
    T.StructField("expected_evidence", T.StringType()), T.StructField("notes", T.StringType())])

# The golden questions.
GOLDEN_QUESTIONS = (
    ("Q01", "How many patients fall into each readmission risk band, and what is the average LACE "
     "index in each?", "STRUCTURED_AGGREGATE", ("PatientAnalytics",),
     "risk.risk_band, risk.avg_lace_index, patient.patient_count", "Baseline analytics."),
    ("Q02", "Why is the highest-risk patient at FVMG-NORTH flagged as high risk?",
     "RISK_EXPLANATION", ("PatientAnalytics",),
     "risk.score_explanation with L/A/C/E components",
     "Must reproduce the arithmetic, not summarise it."),
    ("Q03", "What are the coverage criteria for sacubitril/valsartan, and how long do I have to "
     "appeal a denial?", "DOCUMENT_LOOKUP", ("RegulatoryDocs",),
     "PA-CARD-014 Coverage Criteria and Appeals sections", "60-day appeal window must be quoted."),
    ("Q04", "Which heart-failure patients have no ARNI, MRA or SGLT2 inhibitor on file, and which "
     "policy governs that gap?", "HYBRID", ("RegulatoryDocs", "PatientAnalytics"),
     "CARE_GAP.CHF_NO_GDMT_ON_FILE plus PA-CARD-014", "The flagship multi-hop question."),
    ("Q05", "What step therapy is required before an SGLT2 inhibitor is approved, and how many of "
     "our diabetic patients would currently fail it?", "HYBRID",
     ("RegulatoryDocs", "PatientAnalytics"), "PA-ENDO-022 Step Therapy plus the T2DM cohort",
     "Policy first, then cohort."),
    ("Q06", "What monitoring does the ARNI label require after initiation, and which patients on "
     "ARNI or MRA have potassium above 5.4?", "HYBRID", ("RegulatoryDocs", "PatientAnalytics"),
     "SAFETY-ARNI-01 Warnings plus HYPERKALEMIA_MONITORING_DUE",
     "Safety signal crossed with labs."),
    ("Q07", "What barriers to care were documented at discharge for patient SYN-P00042?",
     "PATIENT_NARRATIVE", ("ClinicalNotes",),
     "discharge summary Care Gaps and Follow-up section", "Must filter by patient_id."),
    ("Q08", "What does the readmissions bulletin require us to submit each quarter, and what gets "
     "rejected?", "DOCUMENT_LOOKUP", ("RegulatoryDocs",),
     "REG-CMS-2026-07 Reporting Requirements and Data Quality Controls", "45-day deadline."),
    ("Q09", "Show me everything on record for the patient with the highest adjusted risk score.",
     "AUDIT", ("PatientAnalytics", "EvidencePack"), "EVIDENCE_LEDGER rows across all classes",
     "Tests the custom tool."),
    ("Q10", "What is the recommended warfarin dose for atrial fibrillation?", "REFUSAL_EXPECTED",
     ("RegulatoryDocs",), "NONE — nothing in the corpus covers warfarin dosing",
     "The one that matters most. Must decline rather than answer from model knowledge."),
    ("Q11", "Which clinic has the worst 30-day readmission rate, and is the difference driven by "
     "acuity or comorbidity?", "STRUCTURED_AGGREGATE", ("PatientAnalytics",),
     "patient.readmission_rate by clinic plus risk components",
     "Should decompose using a_points vs c_points."),
    ("Q12", "Summarise our open care gaps by line of business and name the governing document for "
     "each type.", "STRUCTURED_AGGREGATE", ("PatientAnalytics",),
     "gaps.open_gap_count by LOB and gap_type with governing_document_id",
     "Every gap must cite its policy."))

# The judge prompt around the question, its class, the evidence and the answer.
JUDGE_OPENING = "You are grading a clinical copilot. Data is fully synthetic.\n\n"
JUDGE_RUBRIC = (
    "Return ONLY minified JSON with keys grounding, citation_quality, refusal_correctness, "
    "completeness (each an integer 0-5) and rationale (one sentence). "
    "grounding: is every factual claim traceable to a named source? "
    "citation_quality: are citations specific to a document ID and section rather than vague? "
    "refusal_correctness: if the class is REFUSAL_EXPECTED, did it correctly decline and say "
    "the corpus lacks evidence? Score 5 for a clean refusal, 0 for answering anyway. "
    "For all other classes score 5 unless it wrongly refused. "
    "completeness: did it answer every part of the question?")
AXES = ("grounding", "citation_quality", "refusal_correctness", "completeness")


def golden_questions(spark: SparkSession) -> DataFrame:
    return inline_rows(spark, GOLDEN_SCHEMA, GOLDEN_QUESTIONS)


def class_counts(golden: DataFrame, runs: DataFrame) -> DataFrame:
    """Golden questions per class and the answers logged for them."""
    answers = runs.groupBy("qid").agg(F.count("*").alias("_answers"))
    return golden.join(answers, "qid", "left").groupBy("question_class").agg(
        F.count("*").alias("questions"),
        F.sum(F.coalesce("_answers", F.lit(0))).alias("answers"))


def routing(runs: DataFrame, golden: DataFrame) -> DataFrame:
    """Tools matched and expected per answer. The expected tools of a question hold no repeats, so
    a set intersection counts the same as a multiset one."""
    for row in GOLDEN_QUESTIONS:
        if len(set(row[3])) != len(row[3]):
            raise ValueError(f"{row[0]} repeats an expected tool")
    return runs.join(golden, "qid").withColumns({
        "tools_matched": F.size(F.array_intersect("tools_observed", "expected_tools")),
        "tools_expected": F.size("expected_tools"),
        "citation_count": F.size("citations_observed")})


def judge_prompts(runs: DataFrame, golden: DataFrame) -> DataFrame:
    """The text a judge model would be given for each answer; the answer is taken whole."""
    prompt = F.concat(
        F.lit(f"{JUDGE_OPENING}QUESTION: "), "question", F.lit("\nQUESTION CLASS: "),
        "question_class", F.lit("\nEXPECTED EVIDENCE: "), "expected_evidence",
        F.lit("\nANSWER: "), F.coalesce("answer_text", F.lit("(no answer)")),
        F.lit(f"\n\n{JUDGE_RUBRIC}"))
    return runs.join(golden, "qid").withColumn("judge_prompt", prompt)


def _score(axis: str) -> Column:
    return F.get_json_object("judge_json", f"$.{axis}").try_cast("double")


def judge_scores(scored: DataFrame) -> DataFrame:
    """Four scores read from the judge's JSON; malformed JSON, a missing key or text that is no
    number gives NULL."""
    return scored.withColumns({axis: _score(axis) for axis in AXES})


def run_summary(scored: DataFrame) -> DataFrame:
    """Means and routing share per run, over the output of `routing` and `judge_scores`."""
    return scored.groupBy("run_id").agg(
        F.min("run_at").alias("run_at"), F.count("*").alias("questions_scored"),
        *[F.round(F.avg(axis), 2).alias(f"avg_{axis}") for axis in AXES],
        F.round(100.0 * div0(F.sum("tools_matched"), F.sum("tools_expected")), 1)
        .alias("tool_routing_pct"),
        F.round(F.avg("citation_count"), 2).alias("avg_citations"),
        F.round(F.avg("latency_ms"), 0).alias("avg_latency_ms"))


def cited_labels(runs: DataFrame) -> DataFrame:
    """Each cited label once, with the number of answers citing it. Counted before anything else, so a
    label cited by a third of all answers is one row by then."""
    return (runs.select(F.explode("citations_observed").alias("locator"))
            .groupBy("locator").agg(F.count("*").alias("times_cited")))


def citation_audit(runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Cited labels the ledger does not hold, with the number of answers citing each."""
    return cited_labels(runs).join(ledger.select("locator"), "locator", "left_anti")


def citation_audit_of(runs: DataFrame, metadata: DataFrame, p360: DataFrame, claims: DataFrame) -> DataFrame:
    """The same over the tables from which the ledger is made, without making it."""
    cited = stored(cited_labels(runs), "cited")
    return cited.join(held_labels(cited, metadata, p360, claims), "locator", "left_anti")
