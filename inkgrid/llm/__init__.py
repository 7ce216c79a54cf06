"""Training-data operators: near duplicates, tokenisation, search, scoring, packing."""
