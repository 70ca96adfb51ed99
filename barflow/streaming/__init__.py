"""Structured Streaming versions of the operators, with idempotent sinks."""
