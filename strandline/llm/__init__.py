"""Training-data operators: near-dedup, filtering, redaction, packing, archives and formatting."""
