"""Training-data operators: deduplication, filtering, mixing, encoding and packing of document tables."""
