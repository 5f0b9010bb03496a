"""Column helpers for expressions whose null, tie or text rules differ from Spark's defaults."""

from panel360.functions.scalar import (
    as_ntz,
    div0,
    initcap_punct,
    month_boundaries,
    regex_group,
    to_int_rounded,
    year_boundaries,
)
from panel360.functions.text import html_to_text, tokens

__all__ = ["as_ntz", "div0", "html_to_text", "initcap_punct", "month_boundaries",
           "regex_group", "to_int_rounded", "tokens", "year_boundaries"]
