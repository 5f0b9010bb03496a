"""Text helpers shared by the document and retrieval operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN_PATTERN})"), F.lit(1))


def html_to_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and comments dropped, one line per block element."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    lines = F.regexp_replace(bare, r"(?i)</(p|div|li|h1|h2|tr|title|article|footer)>|<br>", "\n")
    flat = F.regexp_replace(lines, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "),
                         ("&amp;", "&")):
        flat = F.replace(flat, F.lit(entity), F.lit(char))
    return F.regexp_replace(flat, r"\n[ \n\t\r]*", "\n")
