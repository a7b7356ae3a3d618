"""Readers and writers of visibility tables."""
