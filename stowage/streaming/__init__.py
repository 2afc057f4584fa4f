"""Structured Streaming forms of the audit, upload and catalog jobs."""
