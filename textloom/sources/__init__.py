"""Readers and writers of corpus files."""
