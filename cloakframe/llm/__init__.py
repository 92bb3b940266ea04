"""Operators for text used in training data (problems 2 to 8)."""
