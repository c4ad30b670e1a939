"""Operators of a training-data pipeline: mixing, near-duplicates, personal data,
decontamination, web archives, toxicity, secrets, passages, token counts, vectors.

Nothing else in the library imports this subpackage.
"""
