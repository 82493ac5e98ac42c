"""Operators of a training-data pipeline: tokenizing, deduplication, packing, archives, media, classifiers, sketches."""
