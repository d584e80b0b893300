"""Preparing and analysing language-model training data as ordinary Spark tables."""

__version__ = "0.1.0"
