"""Quality gates in one shape: check_name, failing_rows, detail."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Check names and texts.
CHECK_DETAILS = {
    "orphan_encounters": "encounter without a patient record",
    "orphan_claims": "claim without an encounter record",
    "negative_allowed_amount": "allowed_amount below zero",
    "inpatient_missing_admission_source": "rejected by REG-CMS-2026-07 data quality controls",
    "los_exceeds_stay_window": "length_of_stay_days disagrees with admit/discharge dates",
    "implausible_age": "age outside 0-120"}
IDENTIFIER_PATTERNS = {
    "ssn_shape": r"(^|[^0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}([^0-9]|$)",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"}


def _as_checks(one_row: DataFrame, details: Mapping[str, str]) -> DataFrame:
    """One row of counts, turned into a row per check."""
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("check_name"),
                 F.coalesce(F.col(name), F.lit(0)).cast("long").alias("failing_rows"),
                 F.lit(text).alias("detail")) for name, text in details.items()])))


def _details(*names: str) -> dict[str, str]:
    return {name: CHECK_DETAILS[name] for name in names}


def _parents(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("_known", F.lit(True))


def dq_checks(dim: DataFrame, encounters: DataFrame, claims: DataFrame) -> DataFrame:
    """Six checks from one scan per table. Rows are counted per key on the map side before the key
    meets its parent, so a key that fills a third of a table does not pile up in one task, and a
    repeated parent key cannot multiply counts."""
    inpatient = F.col("encounter_type") == "INPATIENT"
    no_source = F.col("admission_source").isNull() | (F.col("admission_source") == "N/A")
    stay = F.date_diff("end_date", "start_date")
    per_patient = encounters.groupBy("patient_id").agg(
        F.count("*").alias("rows"),
        F.count_if(inpatient & no_source).alias("no_source"),
        F.count_if(inpatient & (F.col("length_of_stay_days") != stay)).alias("bad_stay"))
    from_encounters = per_patient.join(_parents(dim, "patient_id"), "patient_id", "left").agg(
        F.sum(F.when(F.col("_known").isNull(), F.col("rows"))).alias("orphan_encounters"),
        F.sum("no_source").alias("inpatient_missing_admission_source"),
        F.sum("bad_stay").alias("los_exceeds_stay_window"))
    per_encounter = claims.groupBy("encounter_id").agg(
        F.count("*").alias("rows"), F.count_if(F.col("allowed_amount") < 0).alias("negative"))
    from_claims = per_encounter.join(
        _parents(encounters, "encounter_id"), "encounter_id", "left").agg(
        F.sum(F.when(F.col("_known").isNull(), F.col("rows"))).alias("orphan_claims"),
        F.sum("negative").alias("negative_allowed_amount"))
    from_dim = dim.agg(F.count_if(~F.col("age_years").between(0, 120)).alias("implausible_age"))
    return (_as_checks(from_encounters, _details("orphan_encounters",
                                                 "inpatient_missing_admission_source",
                                                 "los_exceeds_stay_window"))
            .unionByName(_as_checks(from_claims, _details("orphan_claims",
                                                          "negative_allowed_amount")))
            .unionByName(_as_checks(from_dim, _details("implausible_age"))))


def dq_gate(checks: DataFrame) -> DataFrame:
    """The release condition: no failing row in any check."""
    return checks.agg(F.count("*").alias("checks"), F.sum("failing_rows").alias("failing_rows"),
                      (F.sum("failing_rows") == 0).alias("released"))


class GateFailed(RuntimeError):
    """Raised by `enforce_gate`; the message lists the failing checks."""


def enforce_gate(checks: DataFrame) -> None:
    """Run the checks (a handful of rows) and raise if any fails."""
    failed = checks.filter("failing_rows > 0").collect()
    if failed:
        raise GateFailed("; ".join(f"{r.check_name}: {r.failing_rows}" for r in failed))


@dataclass(frozen=True)
class ColumnTests:
    """What must hold for the columns of a table."""

    not_null: Sequence[str] = ()
    unique: Sequence[str] = ()
    accepted: Mapping[str, Sequence[str]] = field(default_factory=dict)
    references: Mapping[str, tuple[DataFrame, str]] = field(default_factory=dict)


def column_tests(df: DataFrame, tests: ColumnTests) -> DataFrame:
    """Failing rows per test. `unique` counts the rows whose value occurs more than once;
    `references` counts the non-null values without a parent."""
    parts: list[DataFrame] = []
    counts: dict[str, tuple[Column, str]] = {}
    for name in tests.not_null:
        counts[f"not_null_{name}"] = (F.count_if(F.col(name).isNull()), f"{name} is null")
    for name, values in tests.accepted.items():
        counts[f"accepted_values_{name}"] = (
            F.count_if(~F.col(name).isin(*values)), f"{name} outside its value list")
    if counts:
        one_row = df.agg(*[expr.alias(name) for name, (expr, _) in counts.items()])
        parts.append(_as_checks(one_row, {name: text for name, (_, text) in counts.items()}))
    for name in tests.unique:
        repeated = (df.filter(F.col(name).isNotNull()).groupBy(name)
                    .agg(F.count("*").alias("rows")).filter("rows > 1"))
        check = f"unique_{name}"
        parts.append(_as_checks(repeated.agg(F.sum("rows").alias(check)),
                                {check: f"{name} repeats"}))
    for name, (parent, key) in tests.references.items():
        per_key = (df.filter(F.col(name).isNotNull()).groupBy(name)
                   .agg(F.count("*").alias("rows")))
        orphans = per_key.join(parent.select(F.col(key).alias(name)), name, "left_anti")
        check = f"references_{name}"
        parts.append(_as_checks(orphans.agg(F.sum("rows").alias(check)),
                                {check: f"{name} without a parent"}))
    if not parts:
        raise ValueError("no tests given")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def identifier_scan(df: DataFrame, columns: Sequence[str],
                    patterns: Mapping[str, str] = IDENTIFIER_PATTERNS) -> DataFrame:
    """Rows per text column and pattern that hold something shaped like a personal identifier."""
    named = [(column, pattern) for column in columns for pattern in patterns]
    one_row = df.agg(F.count("*").alias("rows"), *[
        F.count_if(F.col(column).rlike(patterns[pattern])).alias(f"{column}__{pattern}")
        for column, pattern in named])
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(column).alias("column_name"), F.lit(pattern).alias("pattern_name"),
                 F.col("rows").alias("rows_scanned"),
                 F.col(f"{column}__{pattern}").alias("rows_matching"))
        for column, pattern in named])))
