"""Operators of a training-data pipeline: archives, filters, quality, tokens, language models, duplicates."""
