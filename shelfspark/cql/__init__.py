"""Contextual Query Language: text to tree to bound predicates to columns."""
