"""Parents and children: windows anchored at the birth that opens them.

Within a group (manager, grouping key, grouping value) the first birth is a
parent with a window of its rule's length; births up to the end of the window,
inclusive, are its children; the next birth after that is the next parent. Each
decision depends on the one before it, which neither `window` (fixed to the
epoch) nor `session_window` (extended by activity) expresses, so in most groups
the decision is an ordered scan of Arrow batches with one open window as its state.

A hot group is never scanned. Every birth points to the first birth after its
own window, whether it is a parent or not, and the parents are what is reached
from the group's first parent. Pointers are doubled (2, 4, 8, ... windows ahead),
each time only for births that some pointer still leads to, until none leads
anywhere; then the parents are marked from the longest pointers down to the
shortest. Pointers, and the parent that each birth then belongs to, are running
values over slots of the group, so a group may have any number of births in a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin.functions.events import expires_at
from tocsin.operators.hot import Limits, hot_keys, running, with_slot
from tocsin.session import materialize, ship_package

GROUP = ["event_manager_id", "grouping_key", "grouping_value"]


def assign_parent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append `family`, the dedup key of the parent (its own for a parent).

    Rows come sorted by group and time. `open_until` and `open_parent` give the
    window that is open before the first of them.
    """
    place, until, parent = None, None, None
    for batch in batches:
        cols = {n: batch.column(n) for n in batch.schema.names}
        groups = list(zip(*[cols[n].to_pylist() for n in GROUP]))
        born = cols["born_at"].cast(pa.int64()).to_numpy()
        families: list[str] = []
        at = 0
        while at < len(born):
            # births are sorted, so go from the end of one window to the next, not from birth to birth
            if groups[at] != place:
                place, parent = groups[at], cols["open_parent"][at].as_py()
                until = cols["open_until"][at].cast(pa.int64()).as_py()
            stop = at
            while stop < len(born) and groups[stop] == place:
                stop += 1
            while at < stop:
                if until is None or born[at] > until:
                    parent = cols["dedup_key"][at].as_py()
                    until = cols["expires_at"][at].cast(pa.int64()).as_py()
                inside = at + int(np.searchsorted(born[at:stop], until, "right"))
                families += [parent] * (inside - at)
                at = inside
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(families, pa.string())], [*batch.schema.names, "family"]
        )


def _timed(births: DataFrame, at: str, seq: str) -> DataFrame:
    """(group..., received_at, seq, dedup_key) with the place that running values go by."""
    return births.select(*GROUP, F.col(at).alias("received_at"), F.expr(seq).alias("seq"), "dedup_key")


def successors(births: DataFrame, hot: DataFrame) -> DataFrame:
    """Stored (node, to): the first birth after the window of each birth; none after the last windows."""
    own = _timed(births, "born_at", "born_seq").withColumn("node", F.lit(None).cast("string"))
    # a window includes its last instant, so its end comes after all births of that instant
    ends = _timed(births, "expires_at", f"{2**63 - 1}L").withColumnRenamed("dedup_key", "node")
    rows = with_slot(own.unionByName(ends, allowMissingColumns=True), GROUP, hot)
    rows = running(materialize(rows, "ends"), GROUP, True, latest={"to": F.col("dedup_key")}, backwards=True)
    return materialize(rows.where("node IS NOT NULL AND to IS NOT NULL").select("node", "to"), "successors")


def reached(successors: DataFrame, firsts: DataFrame) -> DataFrame:
    """Stored (node) of all nodes on the paths that begin at `firsts` (node)."""
    jumps, jump = [], successors
    while not jump.isEmpty():
        jumps.append(jump)
        # who may be asked for a longer jump: the firsts, and whatever a jump leads to
        asked = jump.select(F.col("to").alias("node")).union(firsts).distinct()
        here = jump.join(asked, "node", "left_semi")
        there = jump.select(F.col("node").alias("to"), F.col("to").alias("after"))
        jump = materialize(here.join(there, "to").select("node", F.col("after").alias("to")), "jumps")
    found = firsts
    for jump in reversed(jumps):
        found = materialize(found.union(jump.join(found, "node", "left_semi").select("to")), "reached")
    return found


def _hot_families(births: DataFrame, hot: DataFrame) -> DataFrame:
    """(dedup_key, family) of the births of hot groups; births with `open_until`, `open_parent`."""
    outside = F.col("open_until").isNull() | (F.col("born_at") > F.col("open_until"))
    first = F.min_by("dedup_key", F.struct("born_at", "born_seq"))
    firsts = materialize(births.where(outside).groupBy(*GROUP).agg(first.alias("node")).select("node"), "firsts")
    parents = reached(successors(births, hot), firsts)
    rows = _timed(births, "born_at", "born_seq").join(parents.select(F.col("node").alias("dedup_key"), F.lit(True).alias("opens")), "dedup_key", "left")
    rows = materialize(with_slot(rows, GROUP, hot), "opened")
    rows = running(rows, GROUP, True, latest={"before": F.expr("CASE WHEN opens THEN dedup_key END")})
    return rows.select("dedup_key", F.expr("CASE WHEN opens THEN dedup_key ELSE before END").alias("family"))


def _scanned(births: DataFrame) -> DataFrame:
    schema = T.StructType([*births.schema.fields, T.StructField("family", T.StringType())])
    return (
        births.repartition(*GROUP)
        .sortWithinPartitions(*GROUP, "born_at", "born_seq")
        .mapInArrow(assign_parent, schema)
    )


def links(
    born: DataFrame, limits: Limits | None = Limits(), opened: DataFrame | None = None, also: tuple[str, ...] = ()
) -> DataFrame:
    """Births with `family`, the dedup key of their parent, and `expires_at`.

    `expires_at` is the end of the window an alert opens as a parent. `opened`:
    the windows open before these births, as (group..., open_parent, open_until).
    `also`: other columns to keep.
    """
    ship_package(born.sparkSession)
    born = born.select(
        *GROUP,
        "dedup_key",
        "born_at",
        "born_seq",
        "time_window_minutes",
        "rows",
        "last_at",
        *also,
        expires_at(F.col("born_at"), F.col("time_window_minutes")).alias("expires_at"),
    )
    stats = born.groupBy(*GROUP).agg(
        F.count("*").alias("rows"),
        F.min("born_at").alias("first_at"),
        F.max("born_at").alias("last_at"),
    )
    hot = hot_keys(stats, GROUP, limits)
    if opened is None:
        born = born.selectExpr("*", "CAST(NULL AS timestamp_ntz) AS open_until", "CAST(NULL AS string) AS open_parent")
    else:
        born = born.join(opened.select(*GROUP, "open_until", "open_parent"), GROUP, "left")
    extra = ("open_until", "open_parent")
    if hot is None:
        return _scanned(born).drop(*extra)
    names = hot.select(*GROUP)
    hot_births = materialize(born.join(names, GROUP, "left_semi"), "hot-births")
    found = hot_births.join(_hot_families(hot_births, hot), "dedup_key")
    found = found.withColumn("family", F.coalesce("family", "open_parent"))
    rest = _scanned(born.join(names, GROUP, "left_anti"))
    return rest.unionByName(found).drop(*extra)
