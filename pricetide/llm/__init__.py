"""Training-data operators: language ID, toxicity, de-duplication, mixing, packing, sharding, token counts, search."""
