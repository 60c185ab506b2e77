"""Operators for large text corpora that train language models."""
