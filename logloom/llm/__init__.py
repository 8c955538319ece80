"""Training-data operators: decontamination, quality, near-duplicates, substrings, pages, tokens, shards, language."""
