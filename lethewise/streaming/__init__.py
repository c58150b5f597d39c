"""Structured Streaming forms of resumable jobs."""
