"""Structured Streaming jobs: message scan (stateless) and keyed spend state."""
