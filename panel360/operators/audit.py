"""Grounding scorecard over the answer log, as a table and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panel360.functions import div0


def _measures() -> list[Column]:
    grounded = F.count_if(F.col("grounded"))
    return [F.count("*").alias("answers"), grounded.alias("grounded_answers"),
            F.round(100.0 * div0(grounded, F.count("*")), 1).alias("grounded_pct"),
            F.round(F.avg(F.size("citations")), 2).alias("avg_citations_per_answer"),
            F.round(F.avg("latency_ms"), 0).alias("avg_latency_ms")]


def grounding_scorecard(audit_log: DataFrame) -> DataFrame:
    """Answers, share grounded, citations and latency by day and role."""
    return audit_log.groupBy(F.to_date("asked_at").alias("day"), "asked_role").agg(*_measures())


#: Sums that add up over any split of the log; each column of the scorecard follows from them.
PARTIALS = ("answers", "grounded_answers", "citations", "cited_answers", "latency_ms", "timed_answers")


def scorecard_partials(audit_log: DataFrame) -> DataFrame:
    """Per day and role the counts and sums of some of the log."""
    size = F.when(F.col("citations").isNotNull(), F.size("citations")).cast("long")
    latency = F.col("latency_ms").cast("decimal(38, 6)")
    return audit_log.groupBy(F.to_date("asked_at").alias("day"), "asked_role").agg(
        F.count("*").alias("answers"), F.count_if(F.col("grounded")).alias("grounded_answers"),
        F.sum(size).alias("citations"), F.count(size).alias("cited_answers"),
        F.sum(latency).alias("latency_ms"), F.count("latency_ms").alias("timed_answers"))


def added_partials(partials: DataFrame) -> DataFrame:
    """One row per day and role from any number of partials."""
    return partials.groupBy("day", "asked_role").agg(*[F.sum(c).alias(c) for c in PARTIALS])


def scorecard_of(partials: DataFrame) -> DataFrame:
    """The scorecard of the logs whose partials these are."""
    share = div0(F.col("grounded_answers"), F.col("answers"))
    return added_partials(partials).select(
        "day", "asked_role", "answers", "grounded_answers", F.round(100.0 * share, 1).alias("grounded_pct"),
        F.round(F.try_divide(F.col("citations").cast("double"), "cited_answers"), 2)
        .alias("avg_citations_per_answer"),
        F.round(F.try_divide(F.col("latency_ms").cast("double"), "timed_answers"), 0).alias("avg_latency_ms"))


def scorecard_daily(audit_log: DataFrame) -> DataFrame:
    """The same by tumbling one-day window of a zoned timestamp."""
    return (audit_log.groupBy(F.window("asked_at", "1 day"), "asked_role").agg(*_measures())
            .select(F.col("window.start").cast("date").alias("day"), "asked_role", "answers",
                    "grounded_answers", "grounded_pct", "avg_citations_per_answer",
                    "avg_latency_ms"))
