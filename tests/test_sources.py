from __future__ import annotations

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from panel360 import schemas
from panel360.plans import registry
from panel360.sources import append_rows, conform, inline_rows, read_documents, read_extract
from panel360.sources.tables import audit_defaults


def test_extract_is_positional_and_reads_null_words(spark, tmp_path):
    path = tmp_path / "diagnoses.csv"
    path.write_text('patient_id,icd10_code,description,onset_date,charlson_weight,hcc_flag,'
                    'clinical_status\nP1,I50.9,"a, ""b""",2026-01-02,NULL,1,active\n'
                    'P2,NULL,,,2,,\n')
    rows = read_extract(spark, str(path), schemas.DIAGNOSES).orderBy("patient_id").collect()
    assert rows[0].diagnosis_description == 'a, "b"'
    assert rows[0].onset_date == dt.date(2026, 1, 2) and rows[0].charlson_weight is None
    assert rows[1].icd10_code is None and rows[1].diagnosis_description is None
    assert rows[1].charlson_weight == 2 and rows[1].hcc_flag is None


def test_extract_aborts_on_a_bad_value(spark, tmp_path):
    path = tmp_path / "ed.csv"
    path.write_text("patient_id,ed_visit_date,chief_complaint,admitted_flag\nP1,not a date,x,1\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        read_extract(spark, str(path), schemas.ED_VISITS).collect()


def test_conform_rejects_missing_columns(spark):
    with pytest.raises(ValueError, match="ed_visit_date"):
        conform(spark.range(1).select(F.lit("P").alias("patient_id")), schemas.ED_VISITS)


def test_documents_are_whole_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nline\n")
    (tmp_path / "b.txt").write_text("no")
    rows = read_documents(spark, str(tmp_path)).collect()
    assert [(r.file_name, r.doc_text) for r in rows] == [("a.md", "# T\n\nline\n")]
    assert rows[0].stage_path.endswith("/a.md")


def test_inline_rows_quote_text(spark):
    rows = inline_rows(spark, schemas.ED_VISITS, [("it's \\n", "2026-01-02", None, 1)]).collect()
    assert rows[0].patient_id == "it's \\n" and rows[0].chief_complaint is None
    assert rows[0].ed_visit_date == dt.date(2026, 1, 2)


def test_append_fills_defaults(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(2).select(F.col("id").alias("latency_ms"))
    append_rows(rows, path, audit_defaults("ann", "ANALYST"))
    append_rows(rows, path, audit_defaults("ann", "ANALYST"))
    log = spark.read.parquet(path)
    assert log.count() == 4 and log.select("audit_id").distinct().count() == 4
    assert {r.asked_role for r in log.collect()} == {"ANALYST"}


def test_rows_without_time_are_appended(spark, monkeypatch):
    log = spark.sql("SELECT CAST(t AS timestamp_ntz) AS asked_at, 'x' AS audit_id, 'x' AS asked_by "
                    "FROM VALUES ('2026-01-01 03:00:00'), ('2026-01-01 12:00:00'), (NULL) AS v(t)")
    monkeypatch.setattr(registry.bindings, "audit_log", lambda spark, folder: log)
    got = {r.asked_by: (r.answers, r.ids) for r in registry.appended_log(spark, "").collect()}
    assert got == {"night": (1, 1), "day": (2, 2)}


def test_schemas_hold_money_as_decimals():
    kinds = {f.name: f.dataType.simpleString() for f in schemas.CLAIMS.fields}
    assert kinds["allowed_amount"] == "decimal(18,2)" and len(schemas.EXTRACTS) == 8
    assert decimal.Decimal("0.80") == decimal.Decimal("0.8")
