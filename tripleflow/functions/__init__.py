"""Column functions and small helpers used by the operators."""
