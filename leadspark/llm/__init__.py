"""Operators of a training-data pipeline (filters, de-duplication, tokenising, archives).

Nothing outside this package imports it.  Queries are in ``catalog``.
"""
