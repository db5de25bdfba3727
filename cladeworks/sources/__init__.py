"""Readers and writers of sequence, distance, split, tree and network formats."""
