"""Training-data operators: deduplication, sharding, filters, packing and formatting of text corpora."""
