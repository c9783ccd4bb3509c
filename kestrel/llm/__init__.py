"""Training-data operators: packing, language id, deduplication, tokenising,
pseudonyms, quality scoring and binary token files (see README.md)."""
