"""Incremental intake of documents and the live scorecard."""

from panel360.streaming.documents import (
    compact,
    ingest_documents,
    read_ingested,
    search_ingested,
)
from panel360.streaming.scorecard import compact_scorecard, read_scorecard, start_scorecard

__all__ = ["compact", "compact_scorecard", "ingest_documents", "read_ingested", "read_scorecard",
           "search_ingested", "start_scorecard"]
