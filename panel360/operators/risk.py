"""Additive readmission index with its arithmetic stored beside every score."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panel360.functions import as_ntz

ADHERENCE_FLOOR = "0.80"
# Band thresholds on the index.
HIGH_FROM, INTERMEDIATE_FROM = 10, 5
# Fixed value: the method named beside every score.
METHODOLOGY = ("LACE index (van Walraven et al., CMAJ 2010). Additive, four components, max 19. "
               "Bands: 0-4 LOW, 5-9 INTERMEDIATE, 10+ HIGH. "
               "Modifier columns are LOCAL_HEURISTIC and are excluded from lace_index.")
# Fixed values: (label, column, part of the published index).
COMPONENTS = (("L -- length of stay", "l_points", "yes"),
              ("A -- acuity of admission", "a_points", "yes"),
              ("C -- comorbidity (Charlson)", "c_points", "yes"),
              ("E -- ED visits, prior 6 months", "e_points", "yes"),
              ("Local: adherence", "mod_adherence_point", "no"),
              ("Local: documented barrier", "mod_barrier_point", "no"))


# Points of a stay length: none 0, up to 3 days as they are, 4-6 4, 7-13 5, 14 and more 7.
STAY_POINTS = """CASE WHEN last_inpatient_los IS NULL THEN 0 WHEN last_inpatient_los >= 14 THEN 7
    WHEN last_inpatient_los >= 7 THEN 5 WHEN last_inpatient_los >= 4 THEN 4
    ELSE last_inpatient_los END"""


def points(p360: DataFrame) -> DataFrame:
    """The 360 with the four components, the index, the two local modifiers, the adjusted score
    and the band appended. Only column expressions: no shuffle."""
    scored = p360.selectExpr(
        "*", f"CAST({STAY_POINTS} AS BIGINT) AS l_points",
        "if(last_admission_source = 'EMERGENCY', 3L, 0L) AS a_points",
        "charlson_capped AS c_points",
        "CASE WHEN ed_visits_6mo IS NOT NULL THEN least(ed_visits_6mo, 4L) END AS e_points",
        f"if(worst_pdc < {ADHERENCE_FLOOR}, 1L, 0L) AS mod_adherence_point",
        "if(documented_barrier_to_care, 1L, 0L) AS mod_barrier_point")
    summed = scored.selectExpr("*", "l_points + a_points + c_points + e_points AS lace_index")
    return summed.selectExpr(
        "*", "lace_index + mod_adherence_point + mod_barrier_point AS adjusted_score",
        f"CASE WHEN lace_index >= {HIGH_FROM} THEN 'HIGH' "
        f"WHEN lace_index >= {INTERMEDIATE_FROM} THEN 'INTERMEDIATE' ELSE 'LOW' END AS risk_band")


def explanation() -> Column:
    """The arithmetic as text; a NULL input column makes it NULL, like string concatenation does."""
    return F.expr("""concat(
        'LACE ', lace_index, ' = L', l_points, ' (',
        coalesce(concat('last LOS ', last_inpatient_los, 'd'), 'no inpatient stay'), ') + A',
        a_points, ' (admission source ', coalesce(last_admission_source, 'none'), ') + C',
        c_points, ' (Charlson ', charlson_raw, ', capped at 5) + E', e_points, ' (',
        ed_visits_6mo, ' ED visits in prior 6 months)',
        CASE WHEN mod_adherence_point + mod_barrier_point > 0 THEN concat(
            '. Local modifiers +', mod_adherence_point + mod_barrier_point, ' (',
            trim(concat(
                if(mod_adherence_point = 1,
                   concat('lowest active-medication PDC ', worst_pdc, '; '), ''),
                if(mod_barrier_point = 1,
                   concat('documented barrier: ', coalesce(barrier_to_care, 'yes')), ''))),
            ')') ELSE '' END)""")


def risk_score(p360: DataFrame, scored_at: dt.datetime | None = None) -> DataFrame:
    """One scored row per patient."""
    return points(p360).select(
        "patient_id", "attributed_clinic", "line_of_business",
        "l_points", "a_points", "c_points", "e_points", "lace_index",
        "mod_adherence_point", "mod_barrier_point", "adjusted_score", "risk_band",
        explanation().alias("score_explanation"),
        F.lit(METHODOLOGY).alias("methodology_citation"),
        "last_discharge_date", as_ntz(scored_at).alias("scored_at"))


def score_components(risk: DataFrame) -> DataFrame:
    """The six components of each score as rows."""
    rows = F.array(*[F.struct(F.lit(label).alias("component"), F.col(column).alias("points"),
                              F.lit(published).alias("in_published_index"))
                     for label, column, published in COMPONENTS])
    return risk.select("patient_id", F.inline(rows))


def band_distribution(risk: DataFrame) -> DataFrame:
    """Patients, mean index and mean adjusted score per band."""
    return risk.groupBy("risk_band").agg(
        F.count("*").alias("patients"),
        F.round(F.avg(F.col("lace_index").cast("double")), 2).alias("avg_lace"),
        F.round(F.avg(F.col("adjusted_score").cast("double")), 2).alias("avg_adjusted"))


def band_calibration(risk: DataFrame, outcomes: DataFrame,
                     denominator: str = "index_stay") -> DataFrame:
    """Observed outcome rate per band. `outcomes` has patient_id and outcome (0/1), one row per
    patient with an index stay. The rate is over those patients, or over the whole band with
    denominator="all", where a patient without a stay counts as no event."""
    outcome = F.col("outcome").cast("double")
    if denominator == "all":
        outcome = F.coalesce(outcome, F.lit(0.0))
    elif denominator != "index_stay":
        raise ValueError(f"unknown denominator {denominator!r}")
    return (risk.select("patient_id", "risk_band", "lace_index")
            .join(outcomes.select("patient_id", "outcome"), "patient_id", "left")
            .groupBy("risk_band").agg(
                F.count("*").alias("patients"),
                F.round(F.avg(F.col("lace_index").cast("double")), 3).alias("avg_lace"),
                F.round(F.avg(outcome), 3).alias("observed_readmit_rate")))
