"""Training-data operators: quality, deduplication, PII, toxicity, tokens, packing, search, chat.

Nothing else in the library imports this subpackage.
"""
