"""Training-data operators: dedup, language id, tokens, packing, secrets, vectors."""
