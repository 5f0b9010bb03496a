from __future__ import annotations

from decimal import Decimal

import pytest

from panel360.plans import semantic
from panel360.plans.semantic import SemanticError, semantic_query
from panel360.plans.semantic_model import MODEL


@pytest.fixture(scope="module")
def tables(spark):
    def t(rows, ddl):
        return spark.createDataFrame(rows, ddl)
    return {
        "patient_360": t([("P1", "N", 40, 1), ("P2", "N", 70, 0), ("P3", None, 50, 0)],
                         "patient_id string, attributed_clinic string, age_years int, "
                         "any_readmit_30d int"),
        "risk_readmission": t([("P1", "HIGH", 12, "why1"), ("P2", "LOW", 1, "why2"),
                               ("P3", "LOW", 2, "why3")],
                              "patient_id string, risk_band string, lace_index long, "
                              "score_explanation string"),
        "care_gap": t([("P1", "A", "D1"), ("P1", "B", "D2"), ("P2", "A", "D1")],
                      "patient_id string, gap_type string, governing_document_id string"),
        "fact_claim": t([("C1", "P1", "DENIED", Decimal("5")), ("C2", "P1", "PAID", Decimal("7")),
                         ("C3", "P3", "PAID", Decimal("1"))],
                        "claim_id string, patient_id string, claim_status string, "
                        "allowed_amount decimal(18,2)"),
        "fact_encounter": t([("E1", "P1", 3), ("E1", "P1", 3), ("E2", "P1", None)],
                            "encounter_id string, patient_id string, length_of_stay_days int")}


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_model_counts():
    assert (len(MODEL.entities), len(MODEL.relationships), len(MODEL.dimensions),
            len(MODEL.metrics)) == (8, 7, 38, 16)
    assert sum(len(v) for v in MODEL.facts.values()) == 24


def test_metrics_of_several_grains_do_not_multiply(tables):
    got = semantic_query(tables, ["clinic"], ["patient_count", "open_gap_count", "total_allowed",
                                              "denial_rate", "encounter_total",
                                              "avg_length_of_stay", "readmission_rate"])
    assert rows(got) == [("N", 2, 3, Decimal("12.00"), 0.5, 2, 3.0, 0.5),
                         (None, 1, None, Decimal("1.00"), 0.0, None, None, 0.0)]


def test_partner_dimensions_and_distinct_conditions(tables):
    got = semantic_query(tables, ["attributed_clinic", "risk_band"],
                         ["patient_count", "high_risk_share", "patients_with_gaps"])
    assert rows(got) == [("N", "HIGH", 1, 1.0, 1), ("N", "LOW", 1, 0.0, 1),
                         (None, "LOW", 1, 0.0, None)]


def test_where_companions_and_order(tables):
    got = semantic_query(tables, ["risk.patient_id", "risk.risk_band"], ["avg_lace_index"],
                         where={"risk_band": "HIGH"}, companions=True)
    assert got.columns == ["patient_id", "risk_band", "score_explanation", "avg_lace_index"]
    assert rows(got) == [("P1", "HIGH", "why1", 12.0)]
    gaps = semantic_query(tables, ["gap_type"], ["open_gap_count"], companions=True,
                          order_by=[("open_gap_count", "desc")], limit=1)
    assert rows(gaps) == [("A", "D1", 2)]
    assert rows(semantic_query(tables, [], ["patient_count", "total_allowed"])) == [
        (3, Decimal("13.00"))]


@pytest.mark.parametrize("dims, metrics", [
    (["gap_type"], ["total_cost"]), (["acuity"], ["patient_count"]), (["nothing"], ["avg_age"]),
    (["clinic"], []), (["risk_band"], ["no_metric"])])
def test_rejections(tables, dims, metrics):
    with pytest.raises(SemanticError):
        semantic_query(tables, dims, metrics)


def test_terms_keep_ambiguity(spark):
    asked = spark.createDataFrame([("  ACUITY ",), ("heart   failure",), ("zebra",)],
                                  "term string")
    got = semantic.resolve_terms(asked, semantic.term_table(spark)).collect()
    names = {(r.term.strip().lower(), r.name) for r in got}
    assert names == {("acuity", "risk_band"), ("acuity", "admission_source"),
                     ("heart   failure", "has_chf"), ("zebra", None)}


@pytest.mark.parametrize("dims, where", [
    (["attributed_clinic"], {}), ([], {}), (["risk_band", "sex"], {"attributed_clinic": "AFRICA"}),
    (["attributed_clinic"], {"risk_band": ["HIGH", "LOW"], "sex": "F"})])
def test_one_pass_equals_a_pass_per_entity(panel, dims, where):
    metrics = ["patient_count", "avg_age", "total_cost", "readmission_rate", "avg_worst_pdc",
               "avg_lace_index", "high_risk_count", "high_risk_share", "open_gap_count",
               "patients_with_gaps", "total_allowed", "denial_rate"]
    tables = panel.semantic_tables
    apart = {k: v for k, v in tables.items() if k != "patient_wide"}

    def rows(t):
        return sorted([[round(x, 9) if isinstance(x, float) else x for x in r] for r in
                       semantic_query(t, dims, metrics, where).collect()], key=repr)
    assert rows(tables) == rows(apart)


def test_clinic_of_a_patient_needs_no_fact_table(panel):
    plan = panel.p360.select("patient_id", "attributed_clinic")._jdf.queryExecution() \
        .optimizedPlan().toString()
    assert "o_orderkey" not in plan and "l_orderkey" not in plan
