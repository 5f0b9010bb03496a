"""Full build: extracts and documents in, published tables out.

Each layer is written before the next reads it, so a later layer neither repeats the work of an
earlier one nor depends on anything an executor holds.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from panel360.operators import quality
from panel360.operators.governance import secure_view, tag_columns
from panel360.plans.panel import Panel
from panel360.schemas import EXTRACTS
from panel360.sources import (
    conform,
    read_bucketed,
    read_documents,
    read_extracts,
    read_table,
    write_bucketed,
    write_table,
)

# Layers in build order: attribute of the panel, stored name, partition columns.
LAYERS = ((("dim_patient", "dim_patient", ()), ("metadata", "doc_metadata", ())),
          (("chunks", "doc_chunk", ()), ("signals", "doc_signal", ()),
           ("dq_checks", "dq_checks", ())),
          (("p360", "patient_360", ("attributed_clinic",)), ("member_360", "member_360", ())),
          (("risk", "risk_readmission", ("attributed_clinic",)),
           ("gaps", "care_gap", ("attributed_clinic",))),
          (("ledger", "evidence_ledger", ()),))


def _store(spark: SparkSession, df: DataFrame, path: str, by: tuple[str, ...], table: str | None,
           buckets: int) -> DataFrame:
    """A table written and read back: under a path, or, if it has patients and a name in the catalog, in
    buckets of the patient."""
    tagged = tag_columns(df)
    if table and "patient_id" in df.columns:
        write_bucketed(tagged, table, "patient_id", buckets)
        return tag_columns(read_bucketed(spark, table).select(*df.columns))
    write_table(tagged, path, by)
    return tag_columns(read_table(spark, path, df.schema).select(*df.columns))


def build(spark: SparkSession, panel: Panel, out: str, gate: bool = True, database: str | None = None,
          buckets: int = 64) -> Panel:
    """Write every table under `out` and return a panel that reads them. With `gate`, a failing
    quality check stops the build before anything is derived from the data. With `database`, tables that
    have patients are written to that database of the catalog instead, all in the same buckets of
    patient_id, so that per-patient joins, ranks and masks of them move nothing."""
    def name_of(name: str) -> str | None:
        return f"{database}.{name}" if database else None

    stored: dict[str, DataFrame] = {}
    current = panel
    facts = {}
    for name in EXTRACTS:
        rows = conform(panel.extracts[name], EXTRACTS[name])
        facts[name] = _store(spark, rows, f"{out}/fact_{name}", (), name_of(f"fact_{name}"), buckets)
    for layer in LAYERS:
        current = Panel(facts, panel.documents, panel.as_of, dict(stored), panel.los_basis)
        for attribute, name, by in layer:
            stored[name] = _store(spark, getattr(current, attribute), f"{out}/{name}", by, name_of(name), buckets)
            if gate and name == "dq_checks":
                quality.enforce_gate(stored[name])
    return Panel(facts, panel.documents, panel.as_of, stored, panel.los_basis)


def build_from_files(spark: SparkSession, structured: str, documents: str, out: str,
                     as_of: dt.date, gate: bool = True, database: str | None = None) -> Panel:
    """The build from a folder of CSV extracts and a folder of markdown documents."""
    panel = Panel(read_extracts(spark, structured), read_documents(spark, documents), as_of)
    return build(spark, panel, out, gate, database)


def secure_panel(built: Panel, role: str, entitlement: DataFrame) -> Panel:
    """What `role` sees of every published table of a build."""
    people = built.dim_patient

    def view(df: DataFrame) -> DataFrame:
        return secure_view(tag_columns(df), role, entitlement, people)

    return Panel({name: view(df) for name, df in built.extracts.items()},
                 view(built.documents), built.as_of,
                 {name: view(df) for name, df in (built.stored or {}).items()}, built.los_basis)
