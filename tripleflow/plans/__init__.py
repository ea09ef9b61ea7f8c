"""Whole queries: plans put together from the operators."""
