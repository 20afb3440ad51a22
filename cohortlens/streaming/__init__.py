"""Structured Streaming: incremental import of raw extract files."""

from .ingest import ingest_raw_files, row_rules  # noqa: F401
