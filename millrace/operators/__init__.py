"""Importing this registers the queries of all operators."""

from millrace.operators import display, files, filings, fit, ingest, market, postings, ranking, records, retrieval, search, selection, sidecars, summary
from millrace.streaming import events

__all__ = ["display", "events", "files", "filings", "fit", "ingest", "market", "postings", "ranking", "records", "retrieval", "search", "selection", "sidecars", "summary"]
