"""Operators of a training-data pipeline: tokenising, filtering, deduplication, packing.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries.py`` derives the registered
``opN_*`` queries from them.
"""
