"""Operators for large text corpora: deduplication, filtering, scoring, packing and archives."""
