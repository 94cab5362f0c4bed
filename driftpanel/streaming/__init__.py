"""Structured Streaming entry for the landing zone."""
