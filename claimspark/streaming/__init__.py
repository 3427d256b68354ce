"""Structured Streaming forms of the ingestion and scoring jobs."""
