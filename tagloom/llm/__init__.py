"""Training-data operators: secrets, decontamination, extraction, quality, dedup, packing, shards."""
