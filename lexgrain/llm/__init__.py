"""Training-data operators: cleaning, deduplication, decontamination, mixing and sharding of text."""
