"""Operators of a training-data pipeline: search, extraction, deduplication,
sharding, tokenisation, decontamination and classification over DataFrames.

Nothing outside this subpackage imports it."""
