"""Training-data operators: tokenising, packing, deduplication, scans, classifiers, search and sharding."""
