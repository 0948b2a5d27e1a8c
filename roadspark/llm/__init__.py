"""Operators that a large training-data pipeline needs: near-duplicates, repeats, packing, scoring, search.

Nothing else in the library imports this subpackage.
"""
