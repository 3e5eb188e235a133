"""As-of join: every left row with the newest right row at or before its time.

An equi-join on the key with a time condition would look at all pairs of a
key. Here both sides are put in one ordered log per key and the newest right
row is carried along, so the work is one sort; hot keys are split by `running`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.operators.hot import Limits, hot_keys, running, with_slot
from tocsin.session import materialize

_ORDER = ("received_at", "is_left", "place")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: list[str],
    name: str,
    place: str = "seq",
    limits: Limits = Limits(),
) -> DataFrame:
    """`left` plus the struct column `name`: the newest `right` row of the same key (or null).

    Both sides have the key columns, `received_at` and `place`, which orders
    right rows of equal time. A left row sees right rows of its own time.
    """
    some_key = F.lit(True)
    for c in key:
        some_key &= F.col(c).isNotNull()
    matchable = left.filter(some_key)
    lefts = matchable.select(
        *key,
        "received_at",
        F.lit(1).alias("is_left"),
        F.lit(None).cast("long").alias("place"),
        F.struct(*left.columns).alias("row"),
    )
    rights = right.filter(some_key).select(
        *key,
        "received_at",
        F.lit(0).alias("is_left"),
        F.col(place).cast("long").alias("place"),
        F.struct(*right.columns).alias(name),
    )
    both = lefts.unionByName(rights, allowMissingColumns=True)
    stats = both.groupBy(*key).agg(
        F.count("*").alias("rows"),
        F.min("received_at").alias("first_at"),
        F.max("received_at").alias("last_at"),
    )
    hot = hot_keys(stats, key, limits)
    both = with_slot(both, key, hot)
    if hot is not None:
        both = materialize(both, "asof")  # the carry reads these rows once more
    both = running(
        both,
        key,
        hot is not None,
        latest={"newest": F.col(name)},
        order=_ORDER,
    )
    found = both.filter(F.col("is_left") == 1).select("row.*", F.col("newest").alias(name))
    no_match = F.lit(None).cast(found.schema[name].dataType).alias(name)
    return found.unionByName(left.filter(~some_key).select("*", no_match))
