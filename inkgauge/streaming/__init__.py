"""Structured Streaming wrappers around the stateless plans."""
