"""Training-data operators: quality, privacy, tokens, neighbours and packing."""
