"""Training-data operators: fingerprints, near duplicates, chat windows, quality, PII, mixing, tokens."""
