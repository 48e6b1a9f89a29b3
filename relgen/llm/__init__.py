"""Training-data operators: deduplication, filtering, scoring, formatting and packing of text corpora.

Nothing outside this subpackage imports it.
"""
