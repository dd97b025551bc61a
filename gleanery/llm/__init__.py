"""Operators for preparing training data: deduplication, tokens, filters, sharding, decontamination."""
