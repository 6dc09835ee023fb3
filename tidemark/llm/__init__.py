"""Training-data operators: archives, quality rules, tokens, packing, near duplicates, personal data, sharding."""
