from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from panel360.operators import docs

NOTE = """# Discharge Summary (SYNTHETIC)

**Document ID:** DS-SYN-E0A1
**Patient ID:** SYN-P00042   **Encounter ID:** SYN-E0A1

## Hospital Course
{course}

## Care Gaps and Follow-up Plan
- Follow-up with primary care within 7 days.
- Barriers documented: {barrier}.

## Safety Notes
{safety}

_footer_
"""
POLICY = """# Prior Authorization Policy: X

**Document ID:** PA-CARD-014
**Document Type:** UTILIZATION_POLICY
**Owner:** Health Plan
**Effective Date:** 2026-01-01

## Coverage Criteria
one

## Appeals
two
"""


def raw(spark, **files):
    return spark.createDataFrame([(f"{n}.md", f"s/{n}.md", t) for n, t in files.items()],
                                 "file_name string, stage_path string, doc_text string")


def by_file(df):
    return {r.file_name: r for r in df.collect()}


def test_metadata_paths(spark):
    got = by_file(docs.doc_metadata(raw(
        spark, policy=POLICY, discharge_1=NOTE.format(course="c", barrier="cost", safety="s"),
        bare="no header at all", discharge_2="nothing",
        loose="Title: Drug Safety Label\nIssued by Acme Board.\nEffective from 2026-05-06 on",
        bad=POLICY.replace("2026-01-01", "soon"))))
    p = got["policy.md"]
    assert (p.doc_id, p.doc_type, p.issuing_owner, p.extraction_path, p.scope) == (
        "PA-CARD-014", "UTILIZATION_POLICY", "Health Plan", "REGEX", "INSTITUTIONAL")
    assert p.effective_date == dt.date(2026, 1, 1) and p.doc_title.startswith("Prior")
    n = got["discharge_1.md"]
    assert (n.doc_id, n.patient_id, n.encounter_id, n.scope) == (
        "DS-SYN-E0A1", "SYN-P00042", "SYN-E0A1", "PATIENT_SPECIFIC")
    assert n.doc_type == "DISCHARGE_SUMMARY" and n.effective_date is None
    assert got["bare.md"].doc_id == "DS-bare.md" and got["bare.md"].doc_type == "UNKNOWN"
    assert got["discharge_2.md"].doc_type == "DISCHARGE_SUMMARY"
    loose = got["loose.md"]
    assert (loose.doc_type, loose.issuing_owner, loose.effective_date) == (
        "DRUG_SAFETY_LABEL", "Acme Board", dt.date(2026, 5, 6))
    assert got["bad.md"].effective_date is None
    assert got["bad.md"].extraction_path == "REGEX+RULES"


def test_chunks_follow_sections_and_carry_headings(spark):
    course = " ".join(f"word{i}" for i in range(400))
    meta = docs.doc_metadata(raw(spark, policy=POLICY, discharge_1=NOTE.format(
        course=course, barrier="cost", safety="s")))
    chunks = docs.doc_chunks(meta).orderBy("doc_id", "chunk_index").collect()
    policy = [c for c in chunks if c.doc_id == "PA-CARD-014"]
    assert [c.section_heading for c in policy] == ["Header", "Coverage Criteria", "Appeals"]
    assert policy[1].citation_label == "PA-CARD-014 — Coverage Criteria (chunk 1)"
    note = [c for c in chunks if c.doc_id != "PA-CARD-014"]
    assert [c.chunk_index for c in note] == list(range(len(note)))
    long = [c for c in note if c.section_heading == "Hospital Course"]
    assert len(long) > 3 and all(len(c.chunk_text) <= 900 for c in long)
    for before, after in zip(long, long[1:]):
        shared = max(n for n in range(151) if before.chunk_text.endswith(after.chunk_text[:n]))
        assert shared > 100
    with pytest.raises(ValueError):
        docs.doc_chunks(meta, 100, 200)


@settings(max_examples=5, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab é\n#", max_size=3000), min_size=3, max_size=6))
def test_chunks_hold_the_whole_text(spark, texts):
    files = {f"d{i}": t for i, t in enumerate(texts)}
    chunks = docs.doc_chunks(docs.doc_metadata(raw(spark, **files))).collect()
    for name, text in files.items():
        parts = sorted((c.chunk_index, c.chunk_text) for c in chunks if c.file_name == f"{name}.md")
        left = text
        for _, part in parts:
            overlaps = [n for n in range(min(150, len(part)) + 1)
                        if left.startswith(part[n:]) or left.startswith("\n" + part[n:])]
            assert overlaps, "a piece does not continue the text"
            left = left.removeprefix("\n") if not left.startswith(part[overlaps[0]:]) else left
            left = left[len(part[overlaps[0]:]):]
        assert left.strip("\n") == ""


def test_signals_and_flags(spark):
    safe = "No adverse drug events during admission."
    cases = {"discharge_a": ("transportation", "Mild hypotension."),
             "discharge_b": ("no barriers identified", safe),
             "discharge_c": ("lives alone, limited caregiver support", safe)}
    meta = docs.doc_metadata(raw(spark, **{n: NOTE.format(course="c", barrier=b, safety=s)
                                           for n, (b, s) in cases.items()}, policy=POLICY))
    flags = docs.safety_flags(docs.doc_signals(meta)).collect()
    assert {(r.barrier_to_care, r.has_barrier, r.has_adverse_event, r.followup_days,
             r.followup_specialty) for r in flags} == {
        ("transportation", True, True, 7, "primary care"),
        ("no barriers identified", False, False, 7, "primary care"),
        ("lives alone, limited caregiver support", True, False, 7, "primary care")}
    empty = spark.createDataFrame([("d", "p", "e", "", "", "soon", None)],
                                  "doc_id string, patient_id string, encounter_id string, "
                                  "adverse_event string, barrier_to_care string, "
                                  "followup_days string, followup_specialty string")
    row = docs.safety_flags(empty).first()
    assert not row.has_barrier and not row.has_adverse_event and row.followup_days is None
