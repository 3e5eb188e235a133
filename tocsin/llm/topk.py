"""Exact top-k by inner product as a Voronoi kNN join.

Components become integers (floor(256 x)), so scores are exact. Largest inner products are smallest
distances once every data vector gets one more component, sqrt(M^2 - |o|^2) with M the largest norm, and
every query a zero there: |q - o|^2 = |q|^2 + M^2 - 2 q.o. In that space queries and data are grouped by
their nearest pivot. Summaries of the groups (counts, radii, the smallest pivot distances; bounded by the
number of pivots) bound how far the k-th neighbour of any query of a group can be. A data vector is
replicated to the query groups that it may reach within their bound, and to no others; each pair of a
query block and a part of its data is solved locally by a matrix product, and the parts' best k are
merged per query.

Neighbouring cells with few queries form one block, cells with many are split into several: a block has
about BLOCK_QUERIES queries. The vectors that reach a block are counted first, and its queries are copied to as
many parts as those vectors fill, PART_ROWS each; so a pivot that very many vectors share is spread over many
tasks, and a block that few reach has one part. Distances only decide what is replicated, with a margin for
rounding; scores come from the integers.

Defined results: vectors that are null, hold null or non-finite components, or have another length than
most, take no part, nor do rows without an id; an id stands for one vector (the least, should it come
with several); ties go to the smaller id; an empty table gives an empty result; other columns are
ignored. Components beyond 2^53 / scale, where doubles leave out whole numbers, can't be scored exactly:
`left_out` lists them and all other vectors that take no part, with the reason. Ranks follow the exact scores
in any case; a score that a long can't hold is null in `score` and stands in `exact`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.shared import map_batches, store

K = 5
SCALE = 256
PIVOTS = 48  # vectors that groups form around, chosen by a hash of their id, for each million to the power of 1/3
BLOCK_QUERIES = 16_384
PART_ROWS = 16_384
MARGIN = 1e-6  # relative
WHOLE = 2.0**53  # doubles hold all whole numbers up to here
LIMB = 18  # bits; products of two limbs add up in 64 bits for any number of components up to 2^26

GROUPED = "vec_id long, vector binary, cell int, distance double, norm2 double"


def _reason(id_column: str, scale: int) -> Column:
    """Why a row's vector `x` takes no part by itself; null if it does."""
    return (
        F.when(F.col(id_column).isNull(), "no id")
        .when(F.col("x").isNull() | (F.size("x") == 0), "no vector")
        .when(F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))), "not finite")
        .when(F.exists("x", lambda v: F.abs(v) > F.lit(WHOLE / scale)), "too large")
    )


def _with_reason(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("x"))
    return rows.withColumn("reason", _reason("vec_id", scale))


def quantized(vectors: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """vec_id and the integer components of every usable vector."""
    usable = _with_reason(vectors, id_column, vector_column, scale).where(F.col("reason").isNull())
    return usable.select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("vector"))


def usual_length(numbers: DataFrame) -> int | None:
    """The length that most vectors have, the smaller of two; None without vectors."""
    sizes = numbers.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sizes["n"] if sizes else None


def left_out(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """(vec_id, reason) of the rows that take no part in a search."""
    rows = _with_reason(vectors, id_column, vector_column, scale)
    length = usual_length(quantized(vectors, id_column, vector_column, scale))
    other = F.when(F.size("x") != F.lit(length), "other length")
    return rows.select("vec_id", F.coalesce("reason", other).alias("reason")).where(F.col("reason").isNotNull())


def packed(x: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes, four a component where they fit."""
    short = np.abs(x).max(axis=1) < 2**31
    return [v.astype("<i4" if s else "<i8").tobytes() for v, s in zip(x, short.tolist(), strict=True)]


def unpacked(rows: list[bytes], length: int) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<i4" if len(v) == 4 * length else "<i8") for v in rows]).astype(np.int64)


def stacked(column: pa.Array) -> np.ndarray:
    """A list column as one matrix; all its rows have one length."""
    flat = column.flatten().to_numpy().astype(np.float64)
    return flat.reshape(len(column), -1)


def distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    """Euclidean distances in the space with the additional component."""
    squares = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares + (lift[:, None] - pivot_lift[None, :]) ** 2, 0))


def grouped(vectors: DataFrame, pivots: np.ndarray, largest: float, data: bool) -> DataFrame:
    """Each vector with its cell (nearest pivot), the distance to it and its squared norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = stacked(batch.column("vector"))
            norm2 = (x * x).sum(1)
            lift = np.sqrt(np.maximum(largest - norm2, 0)) if data else np.zeros(len(x))
            away = distances(x, lift, pivots, np.sqrt(np.maximum(largest - (pivots * pivots).sum(1), 0)))
            cell = away.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    pa.array(packed(x), pa.binary()),
                    pa.array(cell.astype(np.int32)),
                    pa.array(away[np.arange(len(x)), cell]),
                    pa.array(norm2),
                ],
                [c.split()[0] for c in GROUPED.split(", ")],
            )

    return map_batches(vectors, run, GROUPED)


def summaries(data: DataFrame, queries: DataFrame, k: int) -> tuple[dict, dict]:
    """Per cell of data its k + 1 smallest pivot distances, per cell of queries count and radius."""

    def nearest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            cell, away = batch.column("cell").to_numpy(), batch.column("distance").to_numpy()
            for c in np.unique(cell).tolist():
                own = np.concatenate([kept.get(c, away[:0]), away[cell == c]])
                kept[c] = np.sort(own)[: k + 1]
        rows = [(c, d) for c, near in kept.items() for d in near.tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.float64())],
            ["cell", "distance"],
        )

    few = map_batches(data.select("cell", "distance"), nearest_of, "cell int, distance double")
    nearest = few.groupBy("cell").agg(F.slice(F.array_sort(F.collect_list("distance")), 1, k + 1).alias("near"))
    own = queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius"))
    return (
        {r["cell"]: r["near"] for r in nearest.collect()},
        {r["cell"]: (r["n"], r["radius"]) for r in own.collect()},
    )


def query_groups(pivots: np.ndarray, own: dict) -> list[list[int]]:
    """Cells with queries, in a chain of nearest pivots, joined while a block has room for their queries."""
    left, out, room = set(own), [], 0
    at = min(left, default=None)
    while left:
        at = min(left, key=lambda c: (float(((pivots[c] - pivots[at]) ** 2).sum()), c))
        left.remove(at)
        if own[at][0] > room:
            out.append([])
            room = BLOCK_QUERIES
        out[-1].append(at)
        room -= own[at][0]
    return out


def bounds(pivots: np.ndarray, largest: float, nearest: dict, own: dict, k: int) -> dict[int, float]:
    """For each cell of queries a distance within which each of them has k neighbours besides itself."""
    lift = np.sqrt(np.maximum(largest - (pivots * pivots).sum(1), 0))
    between = distances(pivots, lift, pivots, lift)
    out = {}
    for cell, (_, radius) in own.items():
        far = sorted(radius + between[cell, other] + d for other, near in nearest.items() for d in near)
        out[cell] = far[k] if len(far) > k else np.inf
    return out


def sides(
    numbers: DataFrame, length: int, is_query: Column, k: int, pivot_count: int
) -> tuple[DataFrame, DataFrame]:
    """Queries and data as (block, part, vec_id, vector): what meets is solved together, and what can't count doesn't meet."""
    spark = numbers.sparkSession
    norm2 = F.aggregate("vector", F.lit(0.0), lambda total, v: total + v.cast("double") * v)
    size = numbers.agg(F.max(norm2).alias("largest"), F.count("*").alias("n")).first()
    largest = size["largest"] or 0.0
    pivot_count = max(pivot_count, int(pivot_count * (size["n"] / 1e6) ** (1 / 3)))
    chosen = numbers.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * pivot_count).select("vector").collect()
    pivots = np.unique(np.array([r["vector"] for r in chosen], np.float64).reshape(-1, length), axis=0)
    pivots = pivots[:: max(1, len(pivots) // pivot_count)][:pivot_count]

    data = store(grouped(numbers, pivots, largest, True), "data")
    queries = store(grouped(numbers.where(is_query), pivots, largest, False), "queries")
    nearest, own = summaries(data, queries, k)
    reach = bounds(pivots, largest, nearest, own, k)

    groups = query_groups(pivots, own)
    blocks = [max(1, -(-sum(own[c][0] for c in cells) // BLOCK_QUERIES)) for cells in groups]
    first = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)  # number of each group's first block
    names = np.array([c for cells in groups for c in cells], np.int64)
    starts = np.cumsum([0] + [len(cells) for cells in groups])[:-1]
    # squares cancel: what rounding may do to a distance goes with the largest norm
    slack = 8 * np.sqrt((length + 8) * np.finfo(float).eps * largest) + MARGIN
    limits = np.array([reach[c] + own[c][1] for c in names.tolist()]) * (1 + MARGIN) + slack

    def reached(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(row, group) of each vector and each query group that it may reach."""
        x = unpacked(batch.column("vector").to_pylist(), length).astype(np.float64)
        own_lift = np.sqrt(np.maximum(largest - (x * x).sum(1), 0))
        lift = np.sqrt(np.maximum(largest - (pivots * pivots).sum(1), 0))
        # |q - o| >= |p - o| - |q - p|: within the bound only if |p - o| <= bound + radius
        near = distances(x, own_lift, pivots, lift)[:, names] <= limits
        return np.nonzero(np.logical_or.reduceat(near, starts, axis=1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(groups), np.int64)
        for batch in batches:
            if batch.num_rows and len(names):
                total += np.bincount(reached(batch)[1], minlength=len(groups))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(groups), dtype=np.int32)), pa.array(total)], ["group", "n"])

    vectors = data.select("vec_id", "vector")
    counted = map_batches(vectors, count, "group int, n long").groupBy("group").agg(F.sum("n").alias("n")).collect()
    replicas = {r["group"]: r["n"] for r in counted}
    parts = np.array([max(1, -(-replicas.get(g, 0) // PART_ROWS)) for g in range(len(groups))], np.int64)

    # a row for each pivot at most
    of_cell = [(c, int(first[g]), blocks[g], int(parts[g])) for g, cells in enumerate(groups) for c in cells]
    cells = spark.createDataFrame(of_cell, "cell int, first int, blocks int, parts int")
    left = (
        queries.join(F.broadcast(cells), "cell")
        .withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("block", "part", "vec_id", "vector")
    )

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            row, group = reached(batch)
            times = np.diff(first)[group]
            row, group, block = np.repeat(row, times), np.repeat(group, times), np.repeat(first[group], times)
            block = block + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            for at in range(0, len(row), 50_000):
                some = pa.array(row[at : at + 50_000])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block[at : at + 50_000].astype(np.int32)),
                        pa.array(parts[group[at : at + 50_000]].astype(np.int32)),
                        batch.column("vec_id").take(some),
                        batch.column("vector").take(some),
                    ],
                    ["block", "parts", "vec_id", "vector"],
                )

    right = map_batches(vectors, replicate, "block int, parts int, vec_id long, vector binary")
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    return left, right.select("block", part.alias("part"), "vec_id", "vector")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = SCALE,
    pivot_count: int = PIVOTS,
) -> DataFrame:
    """query_id, rank, vec_id, score, exact: for each row that `is_query` (of vec_id), its best k of all other rows."""
    numbers = quantized(vectors, id_column, vector_column, scale)
    length = usual_length(numbers)
    if length is None:
        return vectors.sparkSession.createDataFrame(
            [], "query_id long, rank int, vec_id long, score long, exact decimal(38,0)"
        )
    numbers = numbers.where(F.size("vector") == length)
    numbers = store(numbers.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    left, right = sides(numbers, length, is_query, k, pivot_count)

    def solve(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        return best_of(mine, theirs, k, length)

    pairs = left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))
    local = pairs.applyInPandas(solve, "query_id long, vec_id long, high long, low long")
    best = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    unit = F.lit(2**HIGH).cast("decimal(19,0)")
    return (
        local.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select(
            "query_id",
            "rank",
            "vec_id",
            F.when(F.col("high").between(-2, 1), F.shiftleft("high", HIGH) + F.col("low")).alias("score"),
            (F.col("high").cast("decimal(18,0)") * unit + F.col("low")).cast("decimal(38,0)").alias("exact"),
        )
    )


HIGH = 62  # a score is high * 2^62 + low, low from 0: the order of (high, low) is that of scores of any size


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x = sum of limb i times 2^(LIMB * i); all but the last from 0."""
    return [x & (2**LIMB - 1), (x >> LIMB) & (2**LIMB - 1), x >> (2 * LIMB)]


def products(q: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Exact inner products; as Python's numbers where 64 bits may not hold them."""
    largest = int(np.abs(q).max()) * int(np.abs(o).max()) * q.shape[1]
    if largest < 2**52:  # whole numbers that doubles hold
        return (q.astype(np.float64) @ o.T.astype(np.float64)).astype(np.int64)
    if largest < 2**62:
        return q @ o.T
    total = np.zeros((len(q), len(o)), object)
    for i, x in enumerate(limbs(q)):
        for j, y in enumerate(limbs(o)):
            total += (x @ y.T).astype(object) << (LIMB * (i + j))
    return total


def best_of(mine: pd.DataFrame, theirs: pd.DataFrame, k: int, length: int) -> pd.DataFrame:
    """The best k of `theirs` for each of `mine`, but for itself."""
    columns = ["query_id", "vec_id", "high", "low"]
    if mine.empty or theirs.empty:
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
    theirs = theirs.sort_values("vec_id")
    q, o = unpacked(mine["vector"].tolist(), length), unpacked(theirs["vector"].tolist(), length)
    ids, own = theirs["vec_id"].to_numpy(), mine["vec_id"].to_numpy()
    out = []
    for at in range(0, len(q), 256):
        scores = products(q[at : at + 256], o)
        least = np.iinfo(np.int64).min if scores.dtype == np.int64 else -(2**200)
        scores[own[at : at + 256, None] == ids[None, :]] = least
        few = min(k, scores.shape[1])
        if scores.dtype == np.int64:
            floor = np.partition(scores, scores.shape[1] - few, axis=1)[:, scores.shape[1] - few]
        else:
            floor = np.sort(scores, axis=1)[:, scores.shape[1] - few]
        for i, (line, limit) in enumerate(zip(scores, floor, strict=True)):
            at_least = np.nonzero((line >= limit) & (line > least))[0]  # in the order of ids
            best = at_least[np.argsort(-line[at_least], kind="stable")[:k]]
            found = line[best]
            high, low = (found >> HIGH).astype(np.int64), (found & (2**HIGH - 1)).astype(np.int64)
            out.append((np.full(len(best), own[at + i]), ids[best], high, low))
    return pd.DataFrame(dict(zip(columns, (np.concatenate(c) for c in zip(*out)), strict=True)))
