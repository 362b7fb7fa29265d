"""Readers and writers of text and binary formats."""
