"""Readers and writers: column files, weight files, evaluation files, text tables."""
