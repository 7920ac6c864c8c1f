"""Training-data operators: dedup, scoring, counting, packing and archives."""
