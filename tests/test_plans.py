"""What the physical plans must and must not hold."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF
from panel360.operators import docs, evals, gaps, ledger
from panel360.plans import questions
from panel360.plans.registry import QUERIES

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
import compare  # noqa: E402
from oracle import all_statements  # noqa: E402


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unused_rollups_are_dropped(panel):
    text = plan(panel.p360.select("patient_id", "worst_pdc"))
    assert "events" not in text and "documents" not in text


def test_gap_rules_share_one_scan(panel):
    one, six = plan(gaps.care_gaps(panel.p360)), plan(panel.p360)
    assert one.count("FileScan") <= six.count("FileScan")


def test_last_admission_is_combined_before_the_shuffle(spark):
    text = plan(QUERIES["last_admission"](spark, SF))
    assert "partial_max" in text.lower() and "Window" not in text


def test_roster_is_a_bounded_top(panel):
    assert "TakeOrderedAndProject" in plan(questions.risk_roster(panel))


def test_patient_filter_reaches_the_scans(panel):
    text = plan(ledger.evidence_pack(panel.ledger, "SYN-P7"))
    assert text.count("SYN-P7") >= 3 and "TakeOrderedAndProject" in text
    profile = plan(questions.patient_profile(panel, "SYN-P7"))
    assert profile.count("= SYN-P7") >= 5


def test_pruned_columns(spark):
    text = plan(QUERIES["patient_financial"](spark, SF))
    lineitem = next(s for s in re.findall(r"ReadSchema: (struct<[^>]*>)", text)
                    if "l_extendedprice" in s)
    assert "l_tax" not in lineitem and "l_shipdate" not in lineitem


@pytest.mark.parametrize("name", ["patient_360", "evidence_ledger", "doc_chunks", "bm25_topk",
                                  "vector_topk", "note_search", "sv_scoreboard"])
def test_no_python_and_no_cross_product(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


@pytest.mark.parametrize("name", ["risk_readmission", "care_gaps", "doc_chunks", "dq_checks",
                                  "sv_scoreboard", "hybrid_topk", "masked_panel", "eval_summary"])
def test_agrees_with_independent_sql(spark, name):
    statements = compare.oracle_sql()
    difference, _ = compare.compare(spark, compare.connect(SF), SF, name, QUERIES[name],
                                    statements[name])
    assert difference is None, difference
    assert duckdb.__version__


def test_every_query_has_a_statement():
    assert set(all_statements()) == set(QUERIES)


def test_citation_audit_by_labels_equals_the_ledger(spark, panel):
    """Every kind of label, held and not held, and labels that look like another kind's."""
    held = [r.locator for r in panel.ledger.groupBy("source_type").agg(
        F.min("locator").alias("locator")).collect()] + [r.locator for r in panel.ledger.limit(300).collect()]
    others = [None, "", "claim ", "claim SYN-C0", "risk_band + lace_index for SYN-P99999999", " — ", "A — B — C (chunk 1)",
              "CHF_NO_GDMT_ON_FILE governed by NOTHING", "claim X governed by Y — Z (chunk 0)", held[0] + " "]
    runs = spark.createDataFrame([(held + others,), (others[1:],)], "citations_observed array<string>")
    want = evals.citation_audit(runs, panel.ledger)
    got = evals.citation_audit_of(runs, panel.metadata, panel.p360, panel.extracts["claims"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert {r.locator for r in got.collect()} == set(others)


def test_a_document_id_with_a_dash_is_found(spark):
    note = "# T\n\n**Document ID:** A — B\n**Document Type:** X\n\n## H — I\ntext\n"
    metadata = docs.doc_metadata(spark.createDataFrame([("a.md", "a", note)],
                                                       "file_name string, stage_path string, doc_text string"))
    cited = docs.doc_chunks(metadata).select(F.col("citation_label").alias("locator"))
    none = spark.createDataFrame([], "claim_id string")
    labels = sorted(r.locator for r in ledger.held_labels(cited, metadata, None, none).collect())
    assert labels == sorted(r.locator for r in cited.collect()) and any("A — B — H" in x for x in labels)
