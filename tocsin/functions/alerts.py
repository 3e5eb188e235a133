"""Column predicates over the alerts table."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the alerts table.
PARENT, CHILD = "parent", "child"
ACTIVE, RESOLVED = "active", "resolved"


def is_parent() -> Column:
    return F.col("type") == PARENT


def is_child() -> Column:
    return F.col("type") == CHILD


def is_active() -> Column:
    return F.col("status") == ACTIVE


def is_resolved() -> Column:
    return F.col("status") == RESOLVED


def is_pending() -> Column:
    """A parent that was asked to resolve and still waits for its children."""
    return is_active() & F.col("resolve_requested")
