"""Readers and generators of lines and triples."""
