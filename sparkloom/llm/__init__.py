"""Training-data operators: quality, language, extraction, URL rules, vector search, near-duplicates, mixing, tokens, licenses."""
