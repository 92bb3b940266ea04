"""Pipelines and queries composed of operators."""
