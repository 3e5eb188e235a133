"""Tables kept as parts with at most one row per key each, newer parts replacing rows of older ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """The newest row of each key; `parts` from the oldest to the newest, all with the same columns.

    Newer parts are merged by key, and the oldest part's other rows stay where they are.
    """
    oldest, newer = parts[0], parts[1:]
    if not newer:
        return oldest
    if len(newer) == 1:
        rows = newer[0]
    else:
        numbered = [part.withColumn("_number", F.lit(i)) for i, part in enumerate(newer)]
        latest = F.max_by(F.struct(*oldest.columns), "_number")
        keys = [F.col(c).alias(f"_{c}") for c in key]
        rows = reduce(DataFrame.union, numbered).groupBy(*keys).agg(latest.alias("_row")).select("_row.*")
    return oldest.join(rows.select(*key), key, "left_anti").select(*oldest.columns).union(rows)
