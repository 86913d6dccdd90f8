"""Training-data operators: scans, deduplication, tokenizing, search. Nothing outside this folder imports it."""
