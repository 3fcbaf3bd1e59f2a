"""Training-data operators: text extraction, packing, deduplication, search, filtering and output."""
