"""Operators of a training-data pipeline: archives, deduplication, quality, personal data, tokens.

Nothing else in the library imports this subpackage. ``queries.py`` registers one query per operator.
"""
