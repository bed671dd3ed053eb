"""Operators of a training-data pipeline: de-duplication, fingerprints, token files, privacy, toxicity, quality,
nearest neighbours, packing and subword encoding. Nothing else in the library imports this package."""
