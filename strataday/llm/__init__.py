"""Operators for training data: quality, language models, tokens, duplicates, mixing."""
