"""Training-data operators: quality, toxicity, mixing, decontamination, extraction, scans, sharding, joins, digests."""
