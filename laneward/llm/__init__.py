"""Training-data operators: packing, mixing, filtering, dedup, extraction, search and scoring."""
