from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from panel360 import schemas
from panel360.operators import docs, governance, index, ledger, quality, search
from panel360.operators.audit import grounding_scorecard
from panel360.plans import bindings, pipeline
from panel360.plans.panel import Panel
from panel360.sources import read_bucketed, read_table, write_table
from panel360.streaming import (
    compact,
    compact_scorecard,
    ingest_documents,
    read_ingested,
    read_scorecard,
    search_ingested,
    start_scorecard,
)
from panel360.streaming import documents as stream_module
from panel360.streaming import scorecard as scorecard_module
from test_documents import NOTE, POLICY


def put(folder, name, text, when):
    path = folder / name
    path.write_text(text)
    os.utime(path, (when, when))


def test_documents_are_extracted_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    put(folder, "p.md", POLICY, 1_700_000_000)
    ingest_documents(spark, str(folder), out, state, every=None).awaitTermination(60)
    put(folder, "copy_of_p.md", POLICY, 1_700_000_500)
    put(folder, "discharge_1.md", NOTE.format(course="c", barrier="cost", safety="bad reaction"),
        1_700_000_600)
    ingest_documents(spark, str(folder), out, state, every=None).awaitTermination(60)
    ids = sorted(r.doc_id for r in read_ingested(spark, out, "doc_metadata").collect())
    assert ids == ["DS-SYN-E0A1", "PA-CARD-014"]
    batch = docs.doc_chunks(docs.doc_metadata(spark.createDataFrame(
        [("p.md", "p.md", POLICY), ("discharge_1.md", "d", NOTE.format(
            course="c", barrier="cost", safety="bad reaction"))],
        "file_name string, stage_path string, doc_text string")))
    chunks = read_ingested(spark, out, "doc_chunk")
    assert ({r.citation_label for r in chunks.collect()}
            == {r.citation_label for r in batch.collect()})
    assert read_ingested(spark, out, "doc_signal").first().has_barrier
    terms = index.read_index(spark, f"{out}/index", "postings", "citation_label").filter(
        "term = 'criteria'").collect()
    assert [t.citation_label for t in terms] == ["PA-CARD-014 — Coverage Criteria (chunk 1)"]
    with pytest.raises(ValueError):
        read_ingested(spark, out, "nothing")


def test_old_files_and_revisions_count(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    day, now = 86_400, 1_700_000_000

    def note(course, encounter="E0A1"):
        return NOTE.format(course=course, barrier="cost", safety="s").replace("E0A1", encounter)

    def run():
        ingest_documents(spark, str(folder), out, state, every=None).awaitTermination(60)

    put(folder, "p.md", POLICY, now)
    put(folder, "discharge_1.md", note("first"), now)
    run()
    put(folder, "old.md", note("thirty days old", "E0B2"), now - 30 * day)
    put(folder, "discharge_1_v2.md", note("revised"), now + 5)
    put(folder, "discharge_1_v3.md", note("revised again"), now + 9)
    run()
    put(folder, "discharge_1_v0.md", note("an older version, delivered late"), now - 40 * day)
    run()
    current = [("p.md", POLICY), ("old.md", note("thirty days old", "E0B2")),
               ("discharge_1_v3.md", note("revised again"))]
    batch = docs.doc_metadata(spark.createDataFrame(
        [(n, n, t) for n, t in current], "file_name string, stage_path string, doc_text string"))
    for table, made, by in (("doc_metadata", batch, ("doc_id", "file_name", "doc_text")),
                            ("doc_chunk", docs.doc_chunks(batch), ("citation_label", "chunk_text"))):
        want = sorted(tuple(r) for r in made.select(*by).collect())
        assert sorted(tuple(r) for r in read_ingested(spark, out, table).select(*by).collect()) == want
    words = {r.term for r in index.read_index(spark, f"{out}/index", "terms", "citation_label").collect()}
    assert "thirty" in words and "again" in words and "delivered" not in words
    asked = spark.createDataFrame(
        [("q1", "revised again course"), ("q2", "thirty days old cost"), ("q3", "coverage criteria arni"),
         ("q4", "an older version delivered late"), ("q5", "first")], "qid string, question string")

    def found(df):
        return sorted(map(tuple, df.select("qid", "citation_label", "score", "coverage", "rank").collect()))

    want = found(search.text_search(docs.doc_chunks(batch), asked, 4, "citation_label", "chunk_text"))
    assert found(search_ingested(spark, out, asked, 4)) == want
    target = str(tmp_path / "compacted")
    compact(spark, out, target)
    for table in ("doc_chunk", "doc_signal"):
        names = [c for c in read_ingested(spark, out, table).columns if c != "batch"]
        one, two = (sorted(map(repr, read_ingested(spark, o, table).select(names).collect()))
                    for o in (out, target))
        assert one == two
    assert found(search_ingested(spark, target, asked, 4)) == want
    put(folder, "discharge_1_v9.md", note("the compacted tables grow on"), now + 99)
    ingest_documents(spark, str(folder), target, state, every=None).awaitTermination(60)
    batch = docs.doc_metadata(spark.createDataFrame(
        [("p.md", "p.md", POLICY), ("old.md", "old.md", note("thirty days old", "E0B2")),
         ("discharge_1_v9.md", "v9", note("the compacted tables grow on"))],
        "file_name string, stage_path string, doc_text string"))
    assert found(search_ingested(spark, target, asked, 4)) == found(
        search.text_search(docs.doc_chunks(batch), asked, 4, "citation_label", "chunk_text"))


def test_a_stop_after_any_write_shows_the_state_before(spark, tmp_path, monkeypatch):
    """Readers see a batch only when all of it is written; the next run brings it."""
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    put(folder, "p.md", POLICY, 1_700_000_000)
    ingest_documents(spark, str(folder), out, state, every=None).awaitTermination(60)
    asked = spark.createDataFrame([("q", "criteria course revised")], "qid string, question string")

    def state_of():
        return [sorted(map(repr, read_ingested(spark, out, t).collect())) for t in (
            "doc_metadata", "doc_chunk", "doc_signal")] + [
            sorted(map(repr, search_ingested(spark, out, asked, 5).collect()))]

    before = state_of()
    put(folder, "p_v2.md", POLICY.replace("criteria", "criteria revised"), 1_700_000_900)
    put(folder, "discharge_1.md", NOTE.format(course="c", barrier="cost", safety="s"), 1_700_000_900)
    saves = {"n": 0}
    inner, inner_index = stream_module._save, index._save

    def stopping(save):
        def run(*args):
            if saves["n"] == saves["stop"]:
                raise RuntimeError("stopped here")
            saves["n"] += 1
            return save(*args)
        return run

    monkeypatch.setattr(stream_module, "_save", stopping(inner))
    monkeypatch.setattr(index, "_save", stopping(inner_index))
    for stop in range(100):
        saves.update(n=0, stop=stop)
        query = ingest_documents(spark, str(folder), out, state, every=None)
        try:
            query.awaitTermination(120)
        except Exception as error:  # the stream's own error names the cause
            assert "stopped here" in str(error)
            assert state_of() == before
            continue
        break
    assert stop == 9 and state_of() != before
    assert len(read_ingested(spark, out, "doc_metadata").collect()) == 2


@pytest.mark.parametrize("clinics", [("007", "012"), ("2026-01-01", "7e3")])
def test_partition_columns_keep_their_type(spark, tmp_path, clinics):
    df = spark.createDataFrame([("P1", clinics[0]), ("P2", clinics[1])],
                               "patient_id string, attributed_clinic string")
    write_table(df, str(tmp_path / "t"), ("attributed_clinic",))
    back = read_table(spark, str(tmp_path / "t"), df.schema)
    granted = governance.entitlement_table(spark, [("CLINICIAN", clinics[0])])
    assert [tuple(r) for r in governance.row_access(back, "CLINICIAN", granted).select(
        "patient_id", "attributed_clinic").collect()] == [("P1", clinics[0])]


def test_live_scorecard_equals_batch_with_late_rows(spark, tmp_path):
    ddl = ("asked_at timestamp, asked_role string, grounded boolean, citations array<string>, "
           "latency_ms long")
    folder, out = str(tmp_path / "log"), str(tmp_path / "card")

    def rows(*data):
        return spark.createDataFrame(
            [(dt.datetime.fromisoformat(t), r, g, c, n) for t, r, g, c, n in data], ddl)
    first = rows(("2026-01-01T10:00:00", "A", True, ["x"], 10),
                 ("2026-01-02T10:00:00", "A", False, [], 30))
    second = rows(("2026-01-02T11:00:00", "A", True, ["x", "y"], 10),
                  ("2026-01-09T11:00:00", "B", True, ["x"], 10))
    late = rows(("2026-01-01T11:00:00", "A", True, ["x"], 10))
    for part in (first, second, late):
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(ddl).parquet(folder)
        start_scorecard(stream, out, str(tmp_path / "state")).awaitTermination(60)
    def same(*parts):
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.union(part)
        columns = read_scorecard(spark, out).columns
        live = sorted(map(repr, read_scorecard(spark, out).collect()))
        return live == sorted(map(repr, grounding_scorecard(whole).select(*columns).collect()))

    assert same(first, second, late)
    compact_scorecard(spark, out)
    compact_scorecard(spark, out)
    assert same(first, second, late)
    odd = spark.createDataFrame([(None, "A", None, None, None), (dt.datetime(2026, 1, 9), None, True, [], None),
                                 (dt.datetime(2026, 1, 2, 4), "A", True, ["z"], 2**40)], ddl)
    odd.coalesce(1).write.mode("append").parquet(folder)
    start_scorecard(spark.readStream.schema(ddl).parquet(folder), out, str(tmp_path / "state")).awaitTermination(60)
    assert same(first, second, late, odd)
    compact_scorecard(spark, out)
    assert same(first, second, late, odd)


def test_a_batch_of_the_scorecard_reads_its_own_rows_only(spark, tmp_path, monkeypatch):
    ddl = "asked_at timestamp, asked_role string, grounded boolean, citations array<string>, latency_ms long"
    folder, plans = str(tmp_path / "log"), []
    inner = scorecard_module._save
    monkeypatch.setattr(scorecard_module, "_save", lambda df, path: (
        plans.append(df._jdf.queryExecution().optimizedPlan().toString()), inner(df, path)))
    for day in (1, 2, 3):
        spark.createDataFrame([(dt.datetime(2026, 1, day), "A", True, ["x"], 10)], ddl).coalesce(1).write.mode(
            "append").parquet(folder)
        start_scorecard(spark.readStream.schema(ddl).parquet(folder), str(tmp_path / "card"),
                        str(tmp_path / "state")).awaitTermination(60)
    assert len(plans) == 3 and not any("Join" in p or str(tmp_path / "card") in p for p in plans)
    assert read_scorecard(spark, str(tmp_path / "card")).count() == 3


def csv(folder, name, *lines):
    header = ",".join(f.name for f in schemas.EXTRACTS[name].fields)
    (folder / f"{name}.csv").write_text("\n".join([header, *lines]) + "\n")


def test_bucketed_tables_move_nothing(spark, tmp_path, panel):
    """Packs, per-patient joins and masks over a build in the catalog have no exchange by patient."""
    spark.sql(f"CREATE DATABASE built LOCATION '{tmp_path}/db'")
    held = {"spark.sql.autoBroadcastJoinThreshold": "1000", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n) for n in held}
    try:
        made = pipeline.build(spark, panel, str(tmp_path / "out"), gate=False, database="built", buckets=4)
        for n, v in held.items():
            spark.conf.set(n, v)
        tables = {n: governance.tag_columns(read_bucketed(spark, f"built.{n}", keyed_only=True)) for n in (
            "evidence_ledger", "patient_360", "risk_readmission", "care_gap", "dim_patient", "fact_claims")}
        granted = governance.entitlement_table(spark, bindings.CLINIC_ENTITLEMENTS)
        packs = ledger.evidence_packs(tables["evidence_ledger"], tables["patient_360"])
        joined = tables["patient_360"].join(tables["risk_readmission"].select("patient_id", "lace_index"), "patient_id")
        claims = tables["fact_claims"].groupBy("patient_id").agg(F.sum("paid_amount").alias("paid"))
        masked = governance.secure_view(tables["evidence_ledger"], governance.ANALYST, granted)
        rows = governance.secure_view(tables["evidence_ledger"], governance.CLINICIAN, granted,
                                      tables["dim_patient"], spread=False)
        for df in (packs, joined, joined.join(claims, "patient_id", "left"), masked, rows):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(patient_id" not in plan, plan
        spread = governance.secure_view(tables["evidence_ledger"], governance.CLINICIAN, granted, tables["dim_patient"])
        assert rows.count() == spread.count() > 0
        whole = ledger.evidence_packs(panel.ledger, panel.p360)
        assert packs.count() == whole.count()
        assert made.ledger.count() == panel.ledger.count()
        assert made.ledger.filter("patient_id IS NULL").count() == panel.ledger.filter("patient_id IS NULL").count() > 0
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
        spark.sql("DROP DATABASE built CASCADE")


def test_build_from_files(spark, tmp_path):
    structured, documents = tmp_path / "csv", tmp_path / "docs"
    structured.mkdir()
    documents.mkdir()
    csv(structured, "patients", "SYN-P00042,M1,ann,smith,1950-01-01,F,X,OH,43210,EN,N1,0,S")
    csv(structured, "members", "M1,SYN-P00042,Payer,PL,MEDICARE,2025-01-01,,NONE,FVMG-NORTH")
    csv(structured, "encounters",
        "SYN-E0A1,SYN-P00042,INPATIENT,2026-08-01,2026-08-06,5,EMERGENCY,HOME,F,1")
    csv(structured, "claims",
        "C1,SYN-E0A1,M1,SYN-P00042,FACILITY,2026-08-01,9.00,5.00,4.00,1.00,PAID,,")
    csv(structured, "diagnoses", "SYN-P00042,I50.9,CHF,2020-01-01,2,1,active")
    for empty in ("medications", "labs", "ed_visits"):
        csv(structured, empty)
    (documents / "discharge_1.md").write_text(NOTE.format(
        course="secret course", barrier="secret barrier", safety="secret fall after a dose"))
    (documents / "p.md").write_text(POLICY)
    as_of, out = dt.date(2026, 9, 1), str(tmp_path / "out")
    built = pipeline.build_from_files(spark, str(structured), str(documents), out, as_of)
    risk = built.risk.first()
    assert (risk.lace_index, risk.adjusted_score, risk.risk_band) == (9, 10, "INTERMEDIATE")
    assert {r.gap_type for r in built.gaps.collect()} == {
        "CHF_NO_GDMT_ON_FILE", "POST_DISCHARGE_FOLLOWUP_AT_RISK"}
    lazy = Panel(built.extracts, built.documents, as_of)

    def ledger(panel):
        return sorted((r.locator, r.evidence_text) for r in panel.ledger.collect())
    assert ledger(built) == ledger(lazy) and len(ledger(built)) == 11
    assert built.p360.schema["full_name"].metadata["mask"] == "name"
    clinic = built.p360.filter(F.col("attributed_clinic") == "FVMG-NORTH")
    assert "PartitionFilters: [isnotnull(attributed_clinic" in (
        clinic._jdf.queryExecution().executedPlan().toString())
    granted = governance.entitlement_table(spark, [("CLINICIAN", "FVMG-NORTH")])
    for role, rows in (("ANALYST", 1), ("CLINICIAN", 1), ("CARE_MGR", 0)):
        seen = pipeline.secure_panel(built, role, granted)
        assert seen.p360.count() == seen.risk.count() == rows
        tables = {**seen.stored, **seen.extracts}
        text = "\n".join(repr(r) for df in tables.values() for r in df.collect())
        leaks = [line for line in text.lower().split("\n") if "secret" in line]
        assert bool(leaks) == (role == "CLINICIAN"), (role, leaks)
    csv(structured, "claims", "C1,SYN-E9,M1,SYN-P00042,FACILITY,2026-08-01,9,-5,4,1,PAID,,")
    with pytest.raises(quality.GateFailed, match="negative_allowed_amount: 1"):
        pipeline.build_from_files(spark, str(structured), str(documents), out, as_of)
