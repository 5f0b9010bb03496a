"""Evidence ledger: documents, scores, gaps and claims in one shape."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panel360.operators.docs import doc_chunks
from panel360.operators.gaps import gap_array
from panel360.operators.joins import left_join
from panel360.operators.risk import METHODOLOGY, explanation, points

PACK_LIMIT = 120
# Source names and labels of the structured evidence.
RISK_SOURCE, GAP_SOURCE, CLAIM_SOURCE = ("GOLD.RISK_READMISSION", "GOLD.CARE_GAP",
                                         "CURATED.FACT_CLAIM")
COLUMNS = ("evidence_class", "source_id", "locator", "patient_id", "source_type", "context",
           "evidence_text", "as_of_date")
# What the rows of documents and claims are made of.
CHUNK_COLUMNS = ("doc_id", "citation_label", "patient_id", "doc_type", "section_heading", "chunk_text",
                 "effective_date")
CLAIM_COLUMNS = ("claim_id", "patient_id", "claim_status", "denial_reason", "service_date", "allowed_amount",
                 "paid_amount")
# The clinic of a row's patient.
CLINIC = "_clinic"


def _document_rows(chunks: DataFrame, clip: int | None, *carry: str) -> DataFrame:
    text = F.col("chunk_text") if clip is None else F.left("chunk_text", F.lit(clip))
    return chunks.select(
        F.lit("DOCUMENT").alias("evidence_class"), F.col("doc_id").alias("source_id"),
        F.col("citation_label").alias("locator"), "patient_id",
        F.col("doc_type").alias("source_type"), F.col("section_heading").alias("context"),
        text.alias("evidence_text"),
        F.col("effective_date").alias("as_of_date"), *carry)


def _claim_rows(claims: DataFrame, *carry: str) -> DataFrame:
    reason = F.nullif(F.col("denial_reason"), F.lit(""))
    return claims.select(
        F.lit("STRUCTURED").alias("evidence_class"), F.lit(CLAIM_SOURCE).alias("source_id"),
        F.concat(F.lit("claim "), "claim_id").alias("locator"), "patient_id",
        F.lit("CLAIM").alias("source_type"),
        F.concat("claim_status", F.coalesce(F.concat(F.lit(" / "), reason), F.lit("")))
        .alias("context"),
        F.concat(F.lit("Service date "), "service_date", F.lit(", allowed "), "allowed_amount",
                 F.lit(", paid "), "paid_amount", F.lit(", status "), "claim_status")
        .alias("evidence_text"),
        F.col("service_date").alias("as_of_date"), *carry)


def _entry(source: str, locator: Column, kind: str, context: Column, text: Column) -> Column:
    return F.struct(F.lit("STRUCTURED").alias("evidence_class"), F.lit(source).alias("source_id"),
                    locator.alias("locator"), F.lit(kind).alias("source_type"),
                    context.alias("context"), text.alias("evidence_text"))


def _risk_entry(text: Column, method: Column) -> Column:
    return _entry(RISK_SOURCE, F.concat(F.lit("risk_band + lace_index for "), "patient_id"),
                  "RISK_SCORE", F.lit("LACE components L/A/C/E"),
                  F.concat(text, F.lit(" | Methodology: "), method))


def _gap_entry(gap_type: Column, document: Column, detail: Column) -> Column:
    return _entry(GAP_SOURCE, F.concat(gap_type, F.lit(" governed by "), document), "CARE_GAP",
                  gap_type, detail)


def evidence_ledger(chunks: DataFrame, risk: DataFrame, gaps: DataFrame, claims: DataFrame,
                    clip: int | None = None) -> DataFrame:
    """The ledger over stored risk and gap tables. `clip` cuts chunk texts to so many characters."""
    scores = risk.select("patient_id", F.col("scored_at").cast("date").alias("as_of_date"),
                         _risk_entry(F.col("score_explanation"),
                                     F.col("methodology_citation")).alias("e"))
    open_gaps = gaps.select("patient_id", F.col("identified_at").cast("date").alias("as_of_date"),
                            _gap_entry(F.col("gap_type"), F.col("governing_document_id"),
                                       F.col("gap_detail")).alias("e"))
    structured = scores.unionByName(open_gaps).select("patient_id", "as_of_date", "e.*")
    return (_document_rows(chunks, clip).unionByName(structured.select(*COLUMNS))
            .unionByName(_claim_rows(claims)))


def evidence_ledger_from_360(chunks: DataFrame, p360: DataFrame, claims: DataFrame,
                             as_of: dt.date, clip: int | None = None,
                             patients: DataFrame | None = None) -> DataFrame:
    """The same rows straight from the 360: one pass gives each patient's score and gaps, where
    the stored-table form would build the 360 once for either. With `patients` each row also has the clinic
    of its patient in `_clinic`; it is looked up before the texts are made, which are not moved for it."""
    def placed(df: DataFrame, spread: bool = True) -> DataFrame:
        if patients is None:
            return df
        clinics = patients.select("patient_id", F.col("attributed_clinic").alias(CLINIC))
        return left_join(df, clinics, "patient_id", spread)

    carry = () if patients is None else (CLINIC,)
    gap_rows = F.transform(gap_array(), lambda gap: _gap_entry(
        gap["gap_type"], gap["governing_document_id"], gap["gap_detail"]))
    score_row = F.array(_risk_entry(explanation(), F.lit(METHODOLOGY)))
    # The 360 lies by patient already.
    structured = placed(points(p360), spread=False).select(
        "patient_id", F.lit(as_of).alias("as_of_date"), *carry, F.inline(F.concat(score_row, gap_rows)))
    return (_document_rows(placed(chunks.select(*CHUNK_COLUMNS)), clip, *carry)
            .unionByName(structured.select(*COLUMNS, *carry))
            .unionByName(_claim_rows(placed(claims.select(*CLAIM_COLUMNS)), *carry)))


def _order() -> list[Column]:
    return [F.asc("evidence_class"), F.desc_nulls_last("as_of_date"), F.asc("source_id"),
            F.asc("locator")]


def evidence_pack(ledger: DataFrame, patient_id: str | Column,
                  limit: int | None = PACK_LIMIT) -> DataFrame:
    """What is held about one patient: the first `limit` rows, or all without one. The filter on the
    id, a literal or a scalar subquery, reaches the scans of all branches."""
    wanted = F.lit(patient_id) if isinstance(patient_id, str) else patient_id
    rows = ledger.filter(F.col("patient_id") == wanted).orderBy(*_order())
    return (rows if limit is None else rows.limit(limit)).drop("patient_id")


def evidence_packs(ledger: DataFrame, patients: DataFrame | None = None,
                   limit: int | None = PACK_LIMIT) -> DataFrame:
    """The packs of many patients at once, ranked within each; `patients` narrows the set. Without
    `limit` every row is in a pack."""
    if patients is not None:
        ledger = ledger.join(patients.select("patient_id"), "patient_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("patient_id").orderBy(*_order()))
    rows = ledger.filter(F.col("patient_id").isNotNull()).withColumn("pack_row", place)
    return rows if limit is None else rows.filter(F.col("pack_row") <= limit)


def held_labels(cited: DataFrame, metadata: DataFrame, p360: DataFrame, claims: DataFrame) -> DataFrame:
    """Those of the cited labels (column `locator`, each once, in a stored table) that the ledger over
    these tables holds. A label says which table could hold it and under which key, so each table is cut
    down to the cited keys before any row of the ledger is made: only cited documents are cut into
    chunks, claims and patients meet their ids alone. Tables that no label points to are not read."""
    claim, score, governed, section = "claim ", "risk_band + lace_index for ", " governed by ", " — "

    def keyed(start: str, key: str) -> DataFrame:
        return cited.filter(F.col("locator").startswith(start)).select(
            "locator", F.substr("locator", F.lit(len(start) + 1)).alias(key))

    parts = []
    of_claims, of_scores = keyed(claim, "claim_id"), keyed(score, "patient_id")
    if not of_claims.isEmpty():
        parts.append(of_claims.join(claims.select("claim_id"), "claim_id", "left_semi").select("locator"))
    if not of_scores.isEmpty():
        parts.append(of_scores.join(p360.select("patient_id"), "patient_id", "left_semi").select("locator"))
    of_gaps = cited.filter(F.col("locator").contains(governed)).select("locator")
    if not of_gaps.isEmpty():
        gap = F.explode(gap_array())
        open_gaps = p360.select(gap.alias("gap")).select(F.concat(
            F.col("gap.gap_type"), F.lit(governed), F.col("gap.governing_document_id")).alias("locator"))
        parts.append(of_gaps.join(open_gaps.distinct(), "locator", "left_semi"))
    # A document id may hold the dash itself: every beginning that ends at one is a candidate.
    words = F.split("locator", section)
    starts = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(
        F.slice(words, F.lit(1), n), section))
    of_documents = cited.filter(F.col("locator").contains(section)).select("locator", F.explode(starts).alias("doc_id"))
    if not of_documents.isEmpty():
        asked = metadata.join(of_documents.select("doc_id").distinct(), "doc_id", "left_semi")
        parts.append(of_documents.select("locator").distinct().join(
            doc_chunks(asked).select(F.col("citation_label").alias("locator")), "locator", "left_semi"))
    held = cited.limit(0).select("locator")
    for part in parts:
        held = held.union(part)
    return held
