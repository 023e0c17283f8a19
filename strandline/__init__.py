"""Spark-first analytics for ordered measurement streams, and operators for training data."""
