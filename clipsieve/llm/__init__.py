"""Training-data operators: quality rules, deduplication, scans, mixing, packing and token output."""
