"""Scalar helpers. All are built from JVM-side functions, so they stay inside codegen."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters after which INITCAP starts a new word, besides white space. The
# apostrophe is not among them, so O'NEIL becomes O'neil.
INITCAP_DELIMITERS = r"""!?@"^#$&~_,.:;+\-*%/|\\\[\](){}<>"""


def div0(numerator: Column, denominator: Column) -> Column:
    """Quotient as a double; 0 on a zero divisor, NULL when either side is NULL."""
    n, d = numerator.cast("double"), denominator.cast("double")
    return F.when(n.isNull() | d.isNull(), F.lit(None).cast("double")).when(
        d == 0, F.lit(0.0)).otherwise(F.try_divide(n, d))


def year_boundaries(start: Column, end: Column) -> Column:
    """Number of 1 Januaries crossed, not completed years."""
    return F.year(end) - F.year(start)


def month_boundaries(start: Column, end: Column) -> Column:
    """Number of month starts crossed, not completed months."""
    return (F.year(end) * 12 + F.month(end)) - (F.year(start) * 12 + F.month(start))


def initcap_punct(text: Column) -> Column:
    """Capitalise after white space and after the delimiters above; lower-case the rest."""
    pieces = F.split(text, f"(?<=[{INITCAP_DELIMITERS}])")
    return F.array_join(F.transform(pieces, F.initcap), "")


def regex_group(text: Column, pattern: str, group: int = 1) -> Column:
    """Trimmed capture group; NULL on no match and on an empty match."""
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


def to_int_rounded(text: Column) -> Column:
    """Text to integer, rounding half up at scale 0; NULL when it is not a number."""
    return F.round(text.try_cast("decimal(38,6)"), 0).try_cast("int")


def as_ntz(moment: dt.date | dt.datetime | None) -> Column:
    """A fixed moment as a zone-less timestamp; the clock when none is given."""
    if moment is None:
        return F.current_timestamp().cast("timestamp_ntz")
    return F.lit(moment.isoformat(sep=" ") if isinstance(moment, dt.datetime)
                 else moment.isoformat()).cast("timestamp_ntz")
