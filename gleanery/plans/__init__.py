"""Blueprints and the plans they compile to."""
