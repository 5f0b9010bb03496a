"""Role-based masking and row access, driven by column metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panel360.operators.joins import left_join
from panel360.operators.ledger import CLINIC
from panel360.sources.literals import inline_rows

# Roles, sensitivity vocabulary, replacement texts, entitlements.
ADMIN, CLINICIAN, CARE_MGR, ANALYST = "ADMIN", "CLINICIAN", "CARE_MGR", "ANALYST"
ROLES = (ADMIN, CLINICIAN, CARE_MGR, ANALYST)
SENSITIVITY = ("DIRECT_IDENTIFIER", "QUASI_IDENTIFIER", "CLINICAL", "FINANCIAL", "NON_SENSITIVE")
REDACTED = "***REDACTED***"
WITHHELD = "***CLINICAL NARRATIVE WITHHELD FOR THIS ROLE***"
ENTITLEMENTS = (("CLINICIAN", "FVMG-NORTH"), ("CLINICIAN", "FVMG-SOUTH"),
                ("CARE_MGR", "FVMG-NORTH"), ("CARE_MGR", "FVMG-SOUTH"),
                ("CARE_MGR", "PRIME-PRIMARY"), ("CARE_MGR", "RIVERBEND"))
ENTITLEMENT_SCHEMA = T.StructType([T.StructField("role_name", T.StringType()),
                                   T.StructField("attributed_clinic", T.StringType())])
FULL_ACCESS = (ADMIN, CLINICIAN)
ALL_ROWS = (ADMIN, ANALYST)


def entitlement_table(spark: SparkSession, rows=ENTITLEMENTS) -> DataFrame:
    return inline_rows(spark, ENTITLEMENT_SCHEMA, rows)


def mask_name(value: Column, role: str) -> Column:
    """Full; initial and last word for care managers (a one-word name keeps its initial only, or
    the last word would be the whole name); redacted for anyone else."""
    if role in FULL_ACCESS:
        return value
    if role == CARE_MGR:
        words = F.split(F.trim(value), " ")
        return F.concat(F.left(value, F.lit(1)), F.lit("***"), F.when(
            F.size(words) > 1, F.concat(F.lit(" "), F.element_at(words, -1))).otherwise(""))
    return F.lit(REDACTED)


def mask_dob(value: Column, role: str) -> Column:
    """Full, or 1 January of the birth year."""
    return value if role in FULL_ACCESS else F.trunc(value, "year")


def mask_postal(value: Column, role: str) -> Column:
    """Full, or the first three characters."""
    return value if role in FULL_ACCESS else F.concat(F.left(value, F.lit(3)), F.lit("XX"))


def mask_clinical_text(value: Column, role: str) -> Column:
    """Full for care roles, withheld for anyone else."""
    return value if role in (*FULL_ACCESS, CARE_MGR) else F.lit(WITHHELD)


def mask_explanation(value: Column, role: str) -> Column:
    """Full for care roles; for anyone else the arithmetic without the barrier's wording, which ends
    an explanation, before the closing bracket and, in the ledger, the methodology."""
    if role in (*FULL_ACCESS, CARE_MGR):
        return value
    return F.regexp_replace(value, r"(?s)(documented barrier: ).*(\) \| Methodology: .*|\))$",
                            "$1withheld$2")


MASKS = {"name": mask_name, "dob": mask_dob, "postal": mask_postal,
         "clinical_text": mask_clinical_text, "explanation": mask_explanation}


@dataclass(frozen=True)
class Tag:
    """Sensitivity of a column, the mask bound to it, a condition on the rows it applies to, and the
    mask of the other rows."""

    sensitivity: str
    mask: str | None = None
    when: str | None = None
    otherwise: str | None = None


# Columns of the published tables that carry a tag.
TAGS: Mapping[str, Tag] = {
    "full_name": Tag("DIRECT_IDENTIFIER", "name"),
    "first_name": Tag("DIRECT_IDENTIFIER", "name"),
    "last_name": Tag("DIRECT_IDENTIFIER", "name"),
    "birth_date": Tag("QUASI_IDENTIFIER", "dob"),
    "postal_code": Tag("QUASI_IDENTIFIER", "postal"),
    "latest_a1c": Tag("CLINICAL"),
    "total_allowed_amount": Tag("FINANCIAL"),
    "doc_text": Tag("CLINICAL", "clinical_text"),
    "chunk_text": Tag("CLINICAL", "clinical_text"),
    "adverse_event": Tag("CLINICAL", "clinical_text"),
    "documented_adverse_event": Tag("CLINICAL", "clinical_text"),
    "barrier_to_care": Tag("CLINICAL", "clinical_text"),
    "score_explanation": Tag("CLINICAL", "explanation"),
    "term": Tag("CLINICAL", "clinical_text"),
    "evidence_text": Tag("CLINICAL", "clinical_text", "evidence_class = 'DOCUMENT'", "explanation")}


def tag_columns(df: DataFrame, tags: Mapping[str, Tag] = TAGS) -> DataFrame:
    """The table with each tagged column's tag in its field metadata, where it survives joins,
    projections and a Parquet round trip."""
    marked = []
    for name in df.columns:
        tag = tags.get(name)
        if tag is None:
            marked.append(F.col(name))
            continue
        if tag.sensitivity not in SENSITIVITY:
            raise ValueError(f"unknown sensitivity {tag.sensitivity!r}")
        metadata = {"sensitivity": tag.sensitivity}
        metadata |= {k: v for k, v in (("mask", tag.mask), ("mask_when", tag.when),
                                        ("mask_otherwise", tag.otherwise)) if v}
        marked.append(F.col(name).alias(name, metadata=metadata))
    return df.select(marked)


def row_access(df: DataFrame, role: str, entitlement: DataFrame,
               clinic: str = "attributed_clinic") -> DataFrame:
    """All rows for administrators and analysts, entitled clinics for anyone else. The entitlement
    table is a plan literal, so its measured size decides the join strategy."""
    if role in ALL_ROWS:
        return df
    granted = entitlement.filter(F.col("role_name") == role).select(
        F.col("attributed_clinic").alias(clinic))
    return df.join(granted, clinic, "left_semi").select(*df.columns)


def secure_view(df: DataFrame, role: str, entitlement: DataFrame,
                patients: DataFrame | None = None, spread: bool = True) -> DataFrame:
    """What `role` sees of a tagged table. The role is fixed when the plan is built, so a column
    the role may not see is replaced before the scan and never read.

    Rows follow the clinic column; a table that has only patient_id gets the clinic from
    `patients`, and its rows without a patient (institutional documents) stay visible. `spread` as for
    `left_join`.
    """
    order = df.columns
    if "attributed_clinic" in order:
        rows = row_access(df, role, entitlement)
    elif "patient_id" in order and role not in ALL_ROWS:
        if patients is None:
            raise ValueError("a table without a clinic column needs `patients`")
        visible = row_access(patients.select("patient_id", "attributed_clinic"), role, entitlement)
        # Patients are unique, so the join adds no row; rows without a patient are spread over its tasks.
        rows = left_join(df, visible.select("patient_id", F.lit(True).alias("_seen")), "patient_id", spread).filter(
            F.col("patient_id").isNull() | F.col("_seen")).select(*order)
    else:
        rows = df
    return rows.select([_shown(field, role) for field in df.schema.fields])


def _shown(field: T.StructField, role: str) -> Column:
    """A column as `role` sees it."""
    column, tag = F.col(field.name), field.metadata
    if not tag.get("mask"):
        return column
    masked = MASKS[tag["mask"]](column, role)
    if tag.get("mask_when") and role not in FULL_ACCESS:
        other = MASKS[tag["mask_otherwise"]](column, role) if tag.get("mask_otherwise") else column
        masked = F.when(F.expr(tag["mask_when"]), masked).otherwise(other)
    return masked.alias(field.name, metadata=tag)


def secure_by_role(df: DataFrame, entitlement: DataFrame, patients: DataFrame | None = None,
                   roles: Sequence[str] = ROLES) -> DataFrame:
    """What each of `roles` sees of a tagged table, with the role in `role`. The table is built once:
    each row meets its clinic once and is then repeated for the roles that may see it. A table of patients'
    rows that has their clinic in `_clinic` needs no `patients`."""
    fields = [f for f in df.schema.fields if f.name != CLINIC]
    order = [f.name for f in fields]
    if CLINIC in df.columns:
        placed = df.withColumn("_of_all", F.col("patient_id").isNull())
    elif "attributed_clinic" in order:
        placed = df.withColumns({"_clinic": F.col("attributed_clinic"), "_of_all": F.lit(False)})
    elif "patient_id" in order:
        if patients is None:
            raise ValueError("a table without a clinic column needs `patients`")
        clinics = patients.select("patient_id", F.col("attributed_clinic").alias("_clinic"))
        # Rows without a patient belong to everybody; the join spreads them over its tasks.
        placed = left_join(df, clinics, "patient_id").withColumn("_of_all", F.col("patient_id").isNull())
    else:
        placed = df.withColumns({"_clinic": F.lit(None).cast("string"), "_of_all": F.lit(True)})
    granted = entitlement.select(F.col("role_name").alias("role"), F.col("attributed_clinic").alias("_clinic"),
                                 F.lit(True).alias("_granted")).distinct()
    repeated = placed.select(*order, "_clinic", "_of_all", F.explode(F.array(*map(F.lit, roles))).alias("role"))
    # ALL_ROWS roles see every row; the others those of a granted clinic.
    rows = repeated.join(granted, ["role", "_clinic"], "left").filter(
        F.col("role").isin(*ALL_ROWS) | F.col("_of_all") | F.col("_granted")).select(*order, "role")
    shown = []
    for field in fields:
        column = F.col(field.name)
        if field.metadata.get("mask"):
            for role in roles:
                column = F.when(F.col("role") == role, _shown(field, role)).otherwise(column)
            column = column.alias(field.name, metadata=field.metadata)
        shown.append(column)
    return rows.select(*shown, "role")
