"""Operators for preparing training data: entity names, addresses, lists, tokens, leaks, pieces, groups."""
