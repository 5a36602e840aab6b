"""Corpus-scale operators for preparing training data."""
