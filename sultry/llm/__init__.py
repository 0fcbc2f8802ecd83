"""Training-data operators: URL filters, secrets, sharding, decontamination, chat, packing, dedup, quality."""
