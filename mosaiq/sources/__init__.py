"""Readers and writers of arrays."""
