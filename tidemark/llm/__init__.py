"""Training-data operators: search, classifiers, tokenisation, deduplication, scoring.

Nothing outside this package imports it.
"""
