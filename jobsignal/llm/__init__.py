"""Training-data operators: dedup, similarity joins, decontamination, scoring, tokens, packing."""
