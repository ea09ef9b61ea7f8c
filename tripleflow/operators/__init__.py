"""Operators over triples and bindings."""
