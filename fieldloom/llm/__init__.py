"""Corpus-preparation operators: mixing, language identification, sharding, toxicity, deduplication, tokenisation,
quality, extraction and fingerprints. Nothing else in the library imports this subpackage."""
