"""Training-data operators: deduplication, mixing, scoring, fingerprints, tokenizing."""
