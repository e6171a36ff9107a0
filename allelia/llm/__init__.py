"""Training-data operators: chat trees, top-k search, similarity joins, filters, WARC, packing."""
