"""Operators of large-scale training-data pipelines: deduplication, search, mixing,
archives, personal data, quality rules, tokenization, packed ids and language models.

Nothing else in the library imports this subpackage."""
