from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panel360.operators import audit, evals, governance as gov, quality
from panel360.operators.conform import dim_patient
from panel360.operators.joins import left_join
from panel360.plans import bindings
from panel360.schemas import EXTRACTS

PATIENTS, MEMBERS = EXTRACTS["patients"], EXTRACTS["members"]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [("P1", "Ann Marie Smith", dt.date(1950, 5, 6), "43210", "FVMG-NORTH"),
         ("P2", "Cher", dt.date(1960, 7, 8), "12345", "PRIME-PRIMARY"),
         ("P3", None, None, None, None)],
        "patient_id string, full_name string, birth_date date, postal_code string, "
        "attributed_clinic string")


@pytest.mark.parametrize("role, names, born, postal, count", [
    (gov.ADMIN, {"Ann Marie Smith", "Cher", None}, dt.date(1950, 5, 6), "43210", 3),
    (gov.CLINICIAN, {"Ann Marie Smith"}, dt.date(1950, 5, 6), "43210", 1),
    (gov.CARE_MGR, {"A*** Smith", "C***"}, dt.date(1950, 1, 1), "432XX", 2),
    (gov.ANALYST, {gov.REDACTED}, dt.date(1950, 1, 1), "432XX", 3),
    ("STRANGER", set(), None, None, 0)])
def test_role_matrix(spark, people, role, names, born, postal, count):
    seen = gov.secure_view(gov.tag_columns(people), role, gov.entitlement_table(spark)).collect()
    assert len(seen) == count and {r.full_name for r in seen} == names
    if count:
        first = next(r for r in seen if r.patient_id == "P1")
        assert first.birth_date == born and first.postal_code == postal


def test_tables_without_a_clinic_follow_the_patient(spark, people):
    ledger = gov.tag_columns(spark.createDataFrame(
        [("DOCUMENT", "P1", "secret story"), ("STRUCTURED", "P1", "claim"),
         ("DOCUMENT", "P2", "other story"), ("DOCUMENT", None, "policy")],
        "evidence_class string, patient_id string, evidence_text string"))
    granted = gov.entitlement_table(spark)

    def texts(role):
        return {r.evidence_text for r in gov.secure_view(ledger, role, granted, people).collect()}
    assert texts(gov.CLINICIAN) == {"secret story", "claim", "policy"}
    assert texts(gov.ANALYST) == {gov.WITHHELD, "claim"}
    assert texts(gov.CARE_MGR) == {"secret story", "claim", "other story", "policy"}
    with pytest.raises(ValueError):
        gov.secure_view(ledger, gov.CLINICIAN, granted)


def test_narrative_inside_other_texts_is_masked(spark):
    score = "LACE 9 = L4. Local modifiers +1 (documented barrier: lives alone (no ramp)\nfar | off)"
    method = " | Methodology: LACE index (CMAJ 2010). Additive."
    rows = gov.tag_columns(spark.createDataFrame(
        [("STRUCTURED", score + method, score, "fell", "fell")],
        "evidence_class string, evidence_text string, score_explanation string, "
        "documented_adverse_event string, term string"))
    granted = gov.entitlement_table(spark)
    seen = gov.secure_view(rows, gov.ANALYST, granted).first()
    plain = "LACE 9 = L4. Local modifiers +1 (documented barrier: withheld)"
    assert (seen.score_explanation, seen.evidence_text) == (plain, plain + method)
    assert seen.documented_adverse_event == seen.term == gov.WITHHELD
    full = gov.secure_view(rows, gov.CARE_MGR, granted).first()
    assert full.score_explanation == score and full.evidence_text == score + method


def test_all_roles_at_once_equal_one_role_each(spark, people):
    granted = gov.entitlement_table(spark)
    ledger = gov.tag_columns(spark.createDataFrame(
        [("DOCUMENT", "P1", "story"), ("STRUCTURED", "P2", "claim"), ("DOCUMENT", "P3", "other"),
         ("DOCUMENT", None, "policy"), ("DOCUMENT", "P9", "unknown patient")],
        "evidence_class string, patient_id string, evidence_text string"))
    plain = gov.tag_columns(spark.createDataFrame([("a term",)], "term string"))
    for df in (gov.tag_columns(people), ledger, plain):
        together = gov.secure_by_role(df, granted, people).collect()
        for role in gov.ROLES:
            one = gov.secure_view(df, role, granted, people).collect()
            assert sorted(map(repr, ([*r][:-1] for r in together if r.role == role))) == sorted(
                map(repr, map(list, one)))


def test_rows_without_key_spread_in_one_pass(spark, people, make, tmp_path):
    rows = spark.range(10).selectExpr("if(id = 3, 'P1', NULL) AS patient_id", "id")
    rows.write.parquet(str(tmp_path / "ledger"))
    ledger = spark.read.parquet(str(tmp_path / "ledger"))
    granted = gov.entitlement_table(spark)
    hidden = gov.secure_view(ledger, gov.CLINICIAN, granted, people)
    every = gov.secure_by_role(ledger, granted, people)
    make(PATIENTS, {"patient_id": "P1"}, {"patient_id": "P2", "member_id": "M1"}).write.parquet(
        str(tmp_path / "patients"))
    dim = dim_patient(spark.read.parquet(str(tmp_path / "patients")),
                      make(MEMBERS, {"member_id": "M1", "payer_name": "Y"}), dt.date(2026, 1, 1))
    for df in (hidden, every, dim):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and "Union" not in plan
    assert hidden.count() == 10
    assert {r["role"]: r["n"] for r in every.groupBy("role").agg(F.count("*").alias("n")).collect()} == {
        role: gov.secure_view(ledger, role, granted, people).count() for role in gov.ROLES}
    assert {(r.patient_id, r.payer_name) for r in dim.collect()} == {("P1", None), ("P2", "Y")}


def test_left_join_spreads_null_keys(spark):
    left = spark.range(4000).selectExpr("if(id % 4 = 0, CAST(id AS STRING), NULL) AS k", "id", "id AS `odd name`")
    right = spark.range(2000).selectExpr("CAST(id AS STRING) AS k", "id * 2 AS v").union(
        spark.sql("SELECT CAST(NULL AS STRING), 7L"))
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n) for n in held}
    try:
        for n, v in held.items():
            spark.conf.set(n, v)
        joined = left_join(left, right, "k")
        sizes = [r["n"] for r in joined.filter("k IS NULL").groupBy(F.spark_partition_id()).agg(
            F.count("*").alias("n")).collect()]
        got = sorted((r["id"], r["k"], r["v"]) for r in joined.collect())
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 1500
    assert got == [(i, str(i) if i % 4 == 0 else None, 2 * i if i % 4 == 0 and i < 2000 else None)
                   for i in range(4000)]


def test_tags_survive_parquet_and_hidden_columns_are_not_read(spark, people, tmp_path):
    path = str(tmp_path / "people")
    gov.tag_columns(people).write.parquet(path)
    back = spark.read.parquet(path)
    assert back.schema["full_name"].metadata["sensitivity"] == "DIRECT_IDENTIFIER"
    hidden = gov.secure_view(back.select("patient_id", "full_name", "attributed_clinic"),
                             gov.ANALYST, gov.entitlement_table(spark))
    plan = hidden._jdf.queryExecution().executedPlan().toString()
    assert "full_name" not in plan.split("ReadSchema")[1]
    with pytest.raises(ValueError):
        gov.tag_columns(people, {"full_name": gov.Tag("SECRET")})


def test_identifier_scan(spark):
    df = spark.createDataFrame([("call 123-45-6789",), ("a@b.org",), ("1123-45-67890",)],
                               "text string")
    got = {r.pattern_name: r.rows_matching for r in quality.identifier_scan(df, ["text"]).collect()}
    assert got == {"ssn_shape": 1, "email": 1}


def test_scorecard(spark):
    log = spark.createDataFrame(
        [("2026-01-01 10:00:00", "A", True, ["x", "y"], 10), ("2026-01-01 23:00:00", "A", False,
                                                               [], 21),
         ("2026-01-02 01:00:00", "B", True, ["x"], 5)],
        "asked_at string, asked_role string, grounded boolean, citations array<string>, "
        "latency_ms long").withColumn("asked_at", F.to_timestamp("asked_at"))
    want = {("A", 2, 1, 50.0, 1.0, 16.0), ("B", 1, 1, 100.0, 1.0, 5.0)}
    for card in (audit.grounding_scorecard(log), audit.scorecard_daily(log)):
        assert {tuple(r)[1:] for r in card.collect()} == want


def test_judging(spark):
    runs = spark.createDataFrame(
        [("r1", "Q04", "text", ["RegulatoryDocs", "Other"], ["c1"], 10,
          '{"grounding":4,"citation_quality":"3","completeness":"x"}'),
         ("r1", "Q10", None, ["RegulatoryDocs"], [], 20, "{broken"),
         ("r1", "Q01", "t", [], ["c1", "c2"], 30, None)],
        "run_id string, qid string, answer_text string, tools_observed array<string>, "
        "citations_observed array<string>, latency_ms long, judge_json string").withColumn(
        "run_at", F.lit("2026-01-01").cast("timestamp_ntz"))
    golden = evals.golden_questions(spark)
    scored = evals.judge_scores(evals.routing(runs, golden))
    by = {r.qid: r for r in scored.collect()}
    assert (by["Q04"].tools_matched, by["Q04"].tools_expected) == (1, 2)
    assert (by["Q04"].grounding, by["Q04"].citation_quality, by["Q04"].completeness) == (4, 3, None)
    assert by["Q10"].grounding is None and by["Q01"].grounding is None
    total = evals.run_summary(scored).first()
    assert (total.questions_scored, total.tool_routing_pct, total.avg_citations) == (3, 50.0, 1.0)
    prompts = {r.qid: r.judge_prompt for r in evals.judge_prompts(runs, golden).collect()}
    assert "ANSWER: (no answer)\n\nReturn ONLY" in prompts["Q10"]
    ledger = spark.createDataFrame([("c1",), ("c1",)], "locator string")
    assert [tuple(r) for r in evals.citation_audit(runs, ledger).collect()] == [("c2", 1)]
    counts = {r.question_class: (r.questions, r.answers)
              for r in evals.class_counts(golden, runs).collect()}
    assert counts["HYBRID"] == (3, 1) and len(counts) == 7


def test_placed_ledger_equals_a_join_with_the_whole(panel):
    """Clinics looked up before the texts are made: the same rows."""
    granted = gov.entitlement_table(panel.metadata.sparkSession, bindings.CLINIC_ENTITLEMENTS)
    columns = ["role", *panel.ledger.columns]
    want = gov.secure_by_role(gov.tag_columns(panel.ledger), granted, panel.dim_patient).select(columns)
    got = gov.secure_by_role(gov.tag_columns(panel.placed_ledger), granted).select(columns)
    assert got.schema == want.schema
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
