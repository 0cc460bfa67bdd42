"""Training-data operators: language, deduplication, decontamination, scoring, tokenising, search."""
