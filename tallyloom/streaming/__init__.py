"""Structured Streaming jobs over prediction files."""
