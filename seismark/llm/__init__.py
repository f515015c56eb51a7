"""Training-data operators: packing, near-dedup, mixing, substring dedup, quality, search, licences, PII, language."""
