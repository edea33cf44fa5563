"""Streams over tables and synthetic generators."""
