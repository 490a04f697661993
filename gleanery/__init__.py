"""Declarative web-extraction analytics on Spark."""
