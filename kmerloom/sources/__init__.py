"""Readers and writers of sequence and mapping files."""
