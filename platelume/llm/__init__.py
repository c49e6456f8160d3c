"""Training-data operators: extraction, cleaning, deduplication, formatting, tokenising."""
