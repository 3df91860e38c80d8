"""Operators for large text corpora; each module is one operator built by one method."""
