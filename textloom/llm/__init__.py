"""Operators for preparing training text: tokens, toxicity, licences, duplicates, contamination, fingerprints."""
