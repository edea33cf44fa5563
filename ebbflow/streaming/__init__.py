"""Structured Streaming back-ends."""
