"""Training-data operators: sharding, deduplication, packing, filtering, scans and tokenising."""
