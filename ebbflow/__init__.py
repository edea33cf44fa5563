"""Incremental analytics on Spark: learners, detectors, transformers and streams as DataFrame operators."""
