"""Training-data operators: packing, PII, quality, deduplication, mixing, sharding."""
