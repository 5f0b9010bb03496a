"""Scans and sinks."""

from panel360.sources.documents import read_documents, stream_documents
from panel360.sources.extracts import conform, read_extract, read_extracts
from panel360.sources.literals import inline_rows
from panel360.sources.tables import (
    append_rows,
    read_bucketed,
    read_table,
    write_bucketed,
    write_table,
)

__all__ = ["append_rows", "conform", "inline_rows", "read_bucketed", "read_documents", "read_extract",
           "read_extracts", "read_table", "stream_documents", "write_bucketed", "write_table"]
