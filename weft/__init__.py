"""Spark-native skill-graph and trajectory analytics."""

__all__ = ["session"]
