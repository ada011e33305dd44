"""Training-data operators: language ID, search, decontamination, mixing, token counts, deduplication, sharding, quality, packing, spelling variants, prefix tries."""
