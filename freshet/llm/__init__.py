"""Training-data operators: packing, search, deduplication, quality, tokenizing, chat formatting."""
