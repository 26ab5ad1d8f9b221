"""Training-data operators: filtering, deduplication, counting, packing and formatting of text corpora.

Nothing else in ``hopgauge`` imports this subpackage.
"""
