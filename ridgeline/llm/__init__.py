"""Training-data operators: token counts, extraction, decontamination, mixing, search, dedup, quality, scoring, URL filters."""
