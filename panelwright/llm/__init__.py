"""Operators for large text corpora: mixing, fingerprints, counts, duplicates, scores and archives."""
