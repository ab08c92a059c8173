"""Operators of a training-data pipeline: scans, dedup, scoring, tokenisation.

Nothing else in the library imports this package.  Each module holds one
operator; ``registry`` holds the thin registered queries.
"""
