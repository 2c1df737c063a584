"""Readers and writers of alignment, reference, variant and interval files."""
