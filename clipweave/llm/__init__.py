"""Training-data operators: formatting, deduplication, encoding, scoring, mixing.

Nothing outside this subpackage imports it.
"""
