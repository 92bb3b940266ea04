"""Relational operators: profiling, scanning, pseudonyms, noise, risk, restoration, parsing."""
