"""Operators for preparing training data: filters, deduplication, tokenisation, formatting.

Nothing else in the library imports this subpackage; the driver entry adds its queries
when it is present.
"""
