"""Keyed-signal analytics and text recovery as Spark DataFrame operators."""

__version__ = "0.1.0"
