"""Exports and writers."""
