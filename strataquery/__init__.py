"""Spark-native engine for evidence-carrying code and artifact intelligence."""

__version__ = "0.1.0"
