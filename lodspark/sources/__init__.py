"""Readers and writers of archive files."""
