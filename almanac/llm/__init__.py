"""Operators for training-data pipelines: chat formatting, personal data, deduplication, tokens, search, quality, licences."""
