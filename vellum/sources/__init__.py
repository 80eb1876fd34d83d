"""Scans, sources and sinks: parquet tables, corpus files, manifest, index store, sessions."""
