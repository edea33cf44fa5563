"""Learners, transformers, detectors and metrics."""
