"""Training-data operators: scans, mixing, dedup, fingerprints, filters, sharding, packing."""
