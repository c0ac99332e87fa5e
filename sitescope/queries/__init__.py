"""Queries over the test tables, each with its SQL: QUERIES and SQL by name."""

from . import crawl, crawling, frontier, grounding, ingest, issues, listings, names, records, reporting, scans, schema, search, textual

PARTS = (crawl, scans, crawling, frontier, ingest, names, textual, grounding, issues, reporting, search, records, schema, listings)
QUERIES = {k: v for p in PARTS for k, v in p.QUERIES.items()}
SQL = {k: v for p in PARTS for k, v in p.SQL.items()}
