"""Structured Streaming forms: incremental verification, job status, dialogue state, user-supplied scorers."""
