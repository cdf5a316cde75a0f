"""Structured Streaming forms of the resumable log (an extension; batch is the default)."""
