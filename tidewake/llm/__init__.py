"""Training-data operators: deduplication, scans, scoring, packing and media columns.

Nothing outside this folder imports it. Every operator has its own module with
a general interface; ``queries`` holds the thin registered queries.
"""
