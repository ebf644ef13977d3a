"""Structured Streaming form of the stateless corpus pipeline."""
