"""Training-data operators (near-dedup, filters, tokens, search, scoring)."""
