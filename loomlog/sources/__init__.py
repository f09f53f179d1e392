"""Readers and writers of the wire shapes and of our own tables."""
