"""Operators of a training-data pipeline: deduplication, mixing, tokens, toxicity, language, vectors.

Nothing else in the library imports this subpackage; it may use the library's general helpers.
Each module holds one operator with its own interface; ``queries`` registers the thin queries.
"""
