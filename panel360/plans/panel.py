"""The tables of one build, each a lazy DataFrame made once from the ones before it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panel360.operators import conform, docs, gaps, gold, ledger, quality, risk
from panel360.plans.semantic import GAP_COUNT


@dataclass
class Panel:
    """`extracts` are the structured tables by name, `documents` the raw documents (file_name,
    stage_path, doc_text). `stored` replaces any derived table by one already written, so that
    what follows reads it instead of computing it again."""

    extracts: Mapping[str, DataFrame]
    documents: DataFrame
    as_of: dt.date
    stored: Mapping[str, DataFrame] | None = None
    los_basis: str = "max"

    @property
    def as_of_time(self) -> dt.datetime:
        return dt.datetime.combine(self.as_of, dt.time())

    def _kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        kept = (self.stored or {}).get(name)
        return make() if kept is None else kept

    @cached_property
    def dim_patient(self) -> DataFrame:
        return self._kept("dim_patient", lambda: conform.dim_patient(
            self.extracts["patients"], self.extracts["members"], self.as_of))

    @cached_property
    def metadata(self) -> DataFrame:
        return self._kept("doc_metadata", lambda: docs.doc_metadata(self.documents))

    @cached_property
    def chunks(self) -> DataFrame:
        return self._kept("doc_chunk", lambda: docs.doc_chunks(self.metadata))

    @cached_property
    def signals(self) -> DataFrame:
        return self._kept("doc_signal", lambda: docs.safety_flags(docs.doc_signals(self.metadata)))

    @cached_property
    def p360(self) -> DataFrame:
        return self._kept("patient_360", lambda: gold.patient_360(
            self.dim_patient,
            gold.Facts(self.extracts["encounters"], self.extracts["diagnoses"],
                       self.extracts["medications"], self.extracts["labs"],
                       self.extracts["claims"], self.signals),
            self.as_of, self.los_basis, self.as_of_time))

    @cached_property
    def member_360(self) -> DataFrame:
        return self._kept("member_360", lambda: gold.member_360(
            self.extracts["members"], self.extracts["claims"], self.as_of))

    @cached_property
    def risk(self) -> DataFrame:
        return self._kept("risk_readmission", lambda: risk.risk_score(self.p360, self.as_of_time))

    @cached_property
    def gaps(self) -> DataFrame:
        return self._kept("care_gap", lambda: gaps.care_gaps(self.p360, self.as_of_time))

    @cached_property
    def ledger(self) -> DataFrame:
        """One pass over the 360 when scores and gaps are not stored, else over the stored tables."""
        if "evidence_ledger" in (self.stored or {}):
            return self.stored["evidence_ledger"]
        if {"risk_readmission", "care_gap"} <= set(self.stored or {}):
            return ledger.evidence_ledger(self.chunks, self.risk, self.gaps,
                                          self.extracts["claims"])
        return ledger.evidence_ledger_from_360(self.chunks, self.p360, self.extracts["claims"],
                                               self.as_of)

    @property
    def placed_ledger(self) -> DataFrame:
        """The ledger with the clinic of each row's patient."""
        return ledger.evidence_ledger_from_360(self.chunks, self.p360, self.extracts["claims"], self.as_of,
                                               patients=self.dim_patient)

    @cached_property
    def dq_checks(self) -> DataFrame:
        return self._kept("dq_checks", lambda: quality.dq_checks(
            self.dim_patient, self.extracts["encounters"], self.extracts["claims"]))

    @property
    def semantic_tables(self) -> dict[str, DataFrame]:
        """The tables of the semantic model, and one row per patient with score and gap count from
        which metrics of patients, scores and gaps are read in one pass."""
        wide = risk.points(self.p360).withColumns({
            "score_explanation": risk.explanation(), "methodology_citation": F.lit(risk.METHODOLOGY),
            GAP_COUNT: F.size(gaps.gap_array())})
        return {"patient_360": self.p360, "patient_wide": wide, "member_360": self.member_360,
                "risk_readmission": self.risk, "care_gap": self.gaps,
                "fact_encounter": self.extracts["encounters"],
                "fact_claim": self.extracts["claims"],
                "fact_diagnosis": self.extracts["diagnoses"],
                "fact_medication": self.extracts["medications"]}
