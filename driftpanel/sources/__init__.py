"""Readers and decoders for board payloads, settings and model responses."""
