"""Operators for preparing training data: extraction, filtering, duplicates, scoring, token ids."""
