"""Distinct counts that add up: stored HyperLogLog sketches per finest grain.

An exact distinct count must meet every value again for each grain it is asked at. A sketch per finest
grain is written once, a few kilobytes each however many values it stands for; any coarser grain is the
union of its sketches. The estimate's relative standard error is `standard_error(precision)`. Exact
counts stay the default everywhere else; this is for roll-ups asked over and over.

Null values count as no value; a grain without values has an estimate of 0; repeats change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRECISION = 14


def standard_error(precision: int = PRECISION) -> float:
    """Of an estimate, relative to the number: 0.81 % at the default precision."""
    return 1.04 / math.sqrt(2 ** precision)


def distinct_sketches(rows: DataFrame, grain: Sequence[str], value: str, precision: int = PRECISION) -> DataFrame:
    """The grain's columns and a sketch of the values in each. Sketches are made before the shuffle and
    merged behind it, so a grain that holds a third of all rows sends one row per task."""
    return rows.groupBy(*grain).agg(F.hll_sketch_agg(value, precision).alias("sketch"))


def distinct_estimates(sketches: DataFrame, grain: Sequence[str]) -> DataFrame:
    """The coarser grain's columns and distinct_estimate, from sketches alone."""
    return sketches.groupBy(*grain).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"))
