"""Operators of a training-data pipeline: deduplication, filtering,
decontamination, scoring, formatting, fingerprints and tokenisation.

Nothing else in the library imports this package."""
