"""Sharding by minimax contiguous partition: equal texts stay together, and the largest shard is as small as can be.

Rows of equal text form an atomic group. Groups are ordered by a hash of the text; the shards are runs of
that order. The smallest capacity with which `shards` runs suffice is found by binary search, and each
capacity is checked greedily: every shard takes groups until the next would not fit.

The order may have any number of groups, so the driver never sees them all. It sees the order as segments:
buckets of the hash with their total sizes, RESOLUTION at first. A capacity that is feasible when only
segment ends may be cut is feasible; one that isn't even when a segment may be cut anywhere isn't. Between
the two bounds only segments in which a greedy cut may fall matter; those are asked for at a finer
resolution, and so on until the bounds meet. Groups of more than a fair share get a shard of their own
first, since no cut can improve on that. Cuts are then placed, within what the capacity leaves open, as
near as can be to equal shares.

Rows are numbered within their shard in two steps (counts per sub-bucket of the doc_id's hash, then rank
within), so a shard or group of any size spreads over many tasks.

Defined results: a null text has size 8 and is of one group with the empty texts; repeated rows are rows of one
group; an empty table gives an empty result; other columns are ignored; with fewer groups than shards,
some shards stay empty.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import pairwise

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.shared import id_and_text, store

SHARDS = 24
PLACES = 1 << 60  # positions of the hash order
RESOLUTION = 1 << 14  # segments asked for in the first round
FINER = 1 << 8  # parts a segment is split into in later rounds
SLOT_ROWS = 20_000  # rows numbered together in one sub-bucket, about


def sized(docs: DataFrame) -> DataFrame:
    """Stored doc_id, size, text_crc32 and place of each row; rows of equal text have one place."""
    text = F.col("text")
    digest = F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 15)
    return store(
        id_and_text(docs, None).select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.conv(digest, 16, 10).cast("long").alias("place"),
        ),
        "sized",
    )


class Segments:
    """The order as far as it is known: starts of segments, sizes before them, and which are single groups."""

    def __init__(self, rows: list[tuple[int, int, int, bool]]):
        rows = sorted(rows)
        self.ranges = [(start, end) for start, end, _, _ in rows]
        self.atomic = [atomic for _, _, _, atomic in rows]
        self.ends = [0]
        for _, _, size, _ in rows:
            self.ends.append(self.ends[-1] + size)

    @property
    def total(self) -> int:
        return self.ends[-1]

    def cuts(self, capacity: int, shards: int, anywhere: bool) -> list[int] | None:
        """Ends of the runs taken greedily; None if `shards` runs don't suffice."""
        at, out = 0, [0]
        while at < self.total:
            if len(out) > shards:
                return None
            limit = at + capacity
            k = bisect_right(self.ends, limit) - 1
            end = self.ends[k]
            if anywhere and k < len(self.atomic) and not self.atomic[k]:
                end = limit
            if end <= at:
                return None
            at = end
            out.append(at)
        return out

    def least(self, shards: int, anywhere: bool) -> int:
        """The smallest capacity for which the greedy check succeeds."""
        low, high = max(1, -(-self.total // shards)), max(1, self.total)
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, anywhere) is None:
                low = middle + 1
            else:
                high = middle
        return low

    def undecided(self, low: int, high: int, shards: int) -> list[int]:
        """Segments of several groups in which a greedy cut may fall for a capacity from low to high."""
        least = greatest = 0
        out: set[int] = set()
        for _ in range(shards):
            # with the smaller capacity and whole segments only, and with the larger and any cut
            k = bisect_right(self.ends, least + low) - 1
            least = max(least, self.ends[min(k, len(self.atomic))])
            greatest = min(self.total, greatest + high)
            first = max(0, bisect_right(self.ends, least) - 1)
            last = min(len(self.atomic), bisect_right(self.ends, greatest))
            out.update(i for i in range(first, last) if not self.atomic[i])
        return sorted(out)


def segments(groups: DataFrame, ranges: list[tuple[int, int]], parts: int) -> list[tuple[int, int, int, bool]]:
    """(start, end, size, single group) of each non-empty one of `parts` equal parts of each range."""
    span = ranges[0][1] - ranges[0][0]
    width = max(1, -(-span // parts))
    wanted = groups
    if span < PLACES:
        keys = groups.sparkSession.createDataFrame([(start // span,) for start, _ in ranges], "bucket long")
        wanted = groups.withColumn("bucket", F.expr(f"place div {span}")).join(F.broadcast(keys), "bucket", "left_semi")
    found = (
        wanted.groupBy(F.expr(f"place div {width}").alias("part"))
        .agg(F.sum("size").alias("size"), F.min("place").alias("first"), F.max("place").alias("last"))
        .collect()
    )
    return [(r["part"] * width, (r["part"] + 1) * width, r["size"], r["first"] == r["last"]) for r in found]


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """Places at which each shard but the first begins: as few as the order allows, `shards - 1` at most."""
    known = segments(groups, [(0, PLACES)], RESOLUTION)
    while True:
        order = Segments(known)
        high, low = order.least(shards, False), order.least(shards, True)
        if low >= high:
            break
        open_ones = order.undecided(low, high, shards)
        if not open_ones:
            break
        # parts of one width at a time, the widest first
        width = max(order.ranges[i][1] - order.ranges[i][0] for i in open_ones)
        chosen = {order.ranges[i] for i in open_ones if order.ranges[i][1] - order.ranges[i][0] == width}
        known = [x for x in known if (x[0], x[1]) not in chosen]
        known += segments(groups, sorted(chosen), FINER)
    return balanced(order, high, shards)


def balanced(order: Segments, capacity: int, shards: int) -> list[int]:
    """Cuts nearest to equal shares among those that keep every shard within the capacity."""
    if not order.total:
        return []
    # the latest shards must hold what is left: the earliest end that still allows it
    earliest, at = [order.total], order.total
    for _ in range(shards - 1):
        k = next_end(order.ends, at - capacity)
        at = order.ends[k]
        earliest.append(at)
    earliest.reverse()  # earliest[i]: least end of shard i
    cuts, at = [], 0
    for i in range(shards - 1):
        wanted = at + (order.total - at) / (shards - i)
        k = bisect_right(order.ends, wanted) - 1
        options = [order.ends[j] for j in (k, k + 1) if j < len(order.ends)]
        options = [e for e in options if earliest[i] <= e <= at + capacity and e >= at]
        if not options:
            options = [order.ends[next_end(order.ends, max(earliest[i], at))]]
        at = min(options, key=lambda e: (abs(e - wanted), e))
        cuts.append(at)
    starts = {end: start for end, (start, _) in zip(order.ends, order.ranges)}
    return [starts.get(c, PLACES) for c in cuts]


def next_end(ends: list[int], least: int) -> int:
    """Index of the first end that is `least` or more."""
    k = bisect_right(ends, least) - 1
    return k if k >= 0 and ends[k] == least else k + 1


def shard_map(rows: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """Places of groups with a shard of their own (the first shards), and the cuts of the others' order."""
    groups = store(rows.groupBy("place").agg(F.sum("size").alias("size")), "groups")
    alone: list[int] = []
    while len(alone) < shards - 1:
        rest = groups.where(~F.col("place").isin(alone)) if alone else groups
        total = rest.agg(F.sum("size").alias("n")).first()["n"] or 0
        fair = total / (shards - len(alone))
        # fewer than `shards` groups can exceed a fair share
        large = rest.where(F.col("size") > fair).orderBy(F.desc("size"), "place").limit(shards - 1 - len(alone)).collect()
        if not large:
            break
        alone += [r["place"] for r in large]
    rest = groups.where(~F.col("place").isin(alone)) if alone else groups
    return alone, minimax_cuts(rest, shards - len(alone))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    rows = sized(docs)
    alone, cuts = shard_map(rows, shards)
    of_place = F.lit(len(alone))
    for cut in cuts:
        of_place = of_place + (F.col("place") >= cut).cast("int")
    for number, place in enumerate(alone):
        of_place = F.when(F.col("place") == place, F.lit(number)).otherwise(of_place)
    return numbered(rows.withColumn("shard", of_place.cast("int"))).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """With `slot`, from 0 without gaps within each shard: by sub-bucket, then doc_id.

    Sub-buckets go by a number that each stored row has of its own, so equal rows spread as well.
    """
    placed = store(rows.withColumn("row", F.monotonically_increasing_id()), "placed")
    most = max((r["count"] for r in placed.groupBy("shard").count().collect()), default=0)
    buckets = max(1, -(-most // SLOT_ROWS))
    keyed = placed.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = keyed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "row")
    ranked = keyed.withColumn("rank", F.row_number().over(own) - 1)
    return ranked.join(bases, ["shard", "bucket"]).withColumn("slot", (F.col("base") + F.col("rank")).cast("long"))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS) -> None:
    """Write the documents' shard table as one folder per shard."""
    shard(docs, shards).write.partitionBy("shard").parquet(folder)


def largest(sizes: list[int], shards: int) -> int:
    """The optimum for a known order of group sizes, which the search over segments must reach."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    order = Segments([(i, i + 1, b - a, True) for i, (a, b) in enumerate(pairwise(ends))])
    return order.least(shards, False)
