"""Operators for preparing training text: operators, their queries and nothing else.

Nothing outside this package imports it.
"""
