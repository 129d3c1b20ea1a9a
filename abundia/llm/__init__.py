"""Operators of a training-data pipeline: deduplication, quality, mixing, scoring, packing, formatting.

Each module holds one operator with its own interface; ``queries`` binds them to
the test tables and ``oracles`` holds the SQL they are checked against.
"""
