"""Versioned tables, ingest and export."""
