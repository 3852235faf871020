"""Operators for large text corpora: cleaning, counting, encoding, deduplication and packing of documents."""
