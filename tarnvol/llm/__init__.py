"""Training-data pipeline operators: tokens, shards, packing, quality and the de-duplication family."""
