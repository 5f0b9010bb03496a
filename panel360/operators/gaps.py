"""Care-gap rules as data. Each rule names the document that governs it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panel360.functions import as_ntz


@dataclass(frozen=True)
class GapRule:
    gap_type: str
    detail: str
    document: str
    predicate: str


# Rule names, texts, governing documents and thresholds.
RULES: tuple[GapRule, ...] = (
    GapRule("CHF_NO_GDMT_ON_FILE",
            "Active heart failure with no ARNI, MRA or SGLT2 inhibitor on the active medication "
            "list",
            "PA-CARD-014", "has_chf AND NOT on_arni AND NOT on_mra AND NOT on_sglt2"),
    GapRule("T2DM_A1C_ABOVE_TARGET_NO_STEP_UP",
            "HbA1c at or above 7.0% with metformin on file and no SGLT2 inhibitor added",
            "PA-ENDO-022", "has_t2dm AND latest_a1c >= 7.0 AND on_metformin AND NOT on_sglt2"),
    GapRule("CKD_SGLT2_ELIGIBLE_NOT_ON_THERAPY",
            "Chronic kidney disease documented and eligible for SGLT2 inhibitor per coverage "
            "criteria",
            "PA-ENDO-022", "has_ckd AND NOT on_sglt2"),
    GapRule("POST_DISCHARGE_FOLLOWUP_AT_RISK",
            "Inpatient discharge with a documented barrier to care, against a 14-day follow-up "
            "measure",
            "QM-HEDIS-LIKE-03", "last_discharge_date IS NOT NULL AND documented_barrier_to_care"),
    GapRule("LOW_ADHERENCE_RENEWAL_RISK",
            "Lowest active-medication PDC below 0.80, which fails the renewal adherence "
            "requirement",
            "PA-ENDO-022", "worst_pdc < 0.80"),
    GapRule("HYPERKALEMIA_MONITORING_DUE",
            "Serum potassium above 5.4 mmol/L with an ARNI or MRA on file; label requires "
            "monitoring",
            "SAFETY-ARNI-01", "latest_potassium > 5.4 AND (on_arni OR on_mra)"))


def gap_array(rules: Sequence[GapRule] = RULES) -> Column:
    """The open gaps of a 360 row as an array, so that all rules share one pass over the table."""
    fired = F.array(*[F.when(F.expr(rule.predicate), F.struct(
        F.lit(rule.gap_type).alias("gap_type"), F.lit(rule.detail).alias("gap_detail"),
        F.lit(rule.document).alias("governing_document_id"))) for rule in rules])
    return F.filter(fired, lambda gap: gap.isNotNull())


def care_gaps(p360: DataFrame, identified_at: dt.datetime | None = None,
              rules: Sequence[GapRule] = RULES) -> DataFrame:
    """One row per patient and open gap."""
    return p360.select("patient_id", "attributed_clinic", "line_of_business",
                       F.inline(gap_array(rules))).select(
        "*", F.lit("OPEN").alias("gap_status"), as_ntz(identified_at).alias("identified_at"))


def gap_counts(p360: DataFrame, rules: Sequence[GapRule] = RULES) -> DataFrame:
    """Number of open gaps of every patient, zero included; no shuffle."""
    return p360.select("patient_id", F.size(gap_array(rules)).cast("long").alias("open_gaps"))


def gaps_by_document(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("governing_document_id", "gap_type").agg(F.count("*").alias("open_gaps"))
