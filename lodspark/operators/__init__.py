"""Relational operators over typed tables."""
