"""Relational operators of the index: ingest, duplicates, plans, search, workflow."""
