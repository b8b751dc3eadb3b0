"""Operators for training data: duplicates, quality, chats, search, packing, mixing, token files, toxicity, addresses, languages.

Nothing else in the library imports this package.
"""
