"""Index maintenance over Structured Streaming."""
