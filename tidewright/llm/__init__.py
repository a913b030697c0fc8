"""Training-data operators: deduplication, filtering, packing and storage of text corpora.

Nothing outside this subpackage imports it.
"""
