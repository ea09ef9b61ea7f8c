"""Named queries over the given tables, each with the SQL that must agree with it."""

from tripleflow.catalog import joining, logs, matching, ordering, reading, streams  # noqa: F401
from tripleflow.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
