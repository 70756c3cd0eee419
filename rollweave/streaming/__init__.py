"""Structured Streaming forms of the limiter and the loader."""
