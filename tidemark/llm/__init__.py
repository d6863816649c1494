"""Training-data operators: formatting, deduplication, privacy, archives, search, mixing, tokens, language."""
