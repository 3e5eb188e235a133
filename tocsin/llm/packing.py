"""Best-fit packing: token sequences of fixed capacity, best-two-fit over the lengths' histogram.

Documents are tokenized once into pieces of at most `capacity` tokens, which are stored. All that a
packing needs to know is how many pieces there are of each length: at most `capacity` numbers, whatever
the size of the corpus. The driver plans bins on that histogram. A bin is filled greedily (largest
length that fits); then its smallest piece gives way to two pieces that are still to be packed, where
these fit the gap it leaves more tightly. The pattern found is used as often as the counts allow, which
uses up a length each time, so the plan stays short. Every piece is then placed by its rank among the
pieces of its length, without any task seeing more than its own pieces.

Defined results: a null text counts as empty (one piece that holds only the end id); an empty table
gives an empty result; repeated rows and ids are separate documents; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.shared import text_encoder, id_and_text, map_batches, slices, store

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
RANKS = 1 << 40  # pieces of one length that a plan can address

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, idx long"


def pieces_of(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = 0,
              by_word: bool = True, keep_ids: bool = False) -> DataFrame:
    """One row per piece: its document, place there, length and checksum; with `keep_ids` also `ids`.

    `part` and `idx` number the pieces of each length within the task that wrote them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer, by_word)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist()
        for batch in slices(batches):
            rows: list[tuple] = []
            ends = np.array([end_id], "<u4")
            for doc, raw in zip(batch.column("doc_id").to_pylist(), encoder.ids(batch.column("text").to_pylist())):
                ids = np.concatenate([np.frombuffer(raw, encoder.code).astype("<u4"), ends])
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    row = (doc, piece, start, len(own), zlib.crc32(own), part, seen[len(own)])
                    rows.append((*row, own.tobytes()) if keep_ids else row)
                    seen[len(own)] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names
            )

    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * keep_ids
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()] + [pa.binary()] * keep_ids
    return map_batches(id_and_text(docs), cut, PIECES + ", ids binary" * keep_ids)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Patterns (copies, {length: pieces in each bin}) that together use all `counts` pieces.

    Python's long integers serve as sets of lengths: bit n stands for length n.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    present = sum(1 << n for n in left)
    plan = []

    def largest(lengths: int, limit: int) -> int:
        return (lengths & ((1 << (limit + 1)) - 1)).bit_length() - 1

    while present:
        use: dict[int, int] = {}
        free, gap = present, capacity
        while (n := largest(free, gap)) > 0:
            use[n] = min(gap // n, left[n])
            gap -= n * use[n]
            if left[n] == use[n]:
                free ^= 1 << n
        while gap and use:
            small = min(use)
            room = gap + small
            use[small] -= 1
            free |= 1 << small
            best = (small, 0, 0)
            a = largest(free, room - 1)
            while a > 0 and 2 * a > best[0] and best[0] < room:
                twice = left[a] - use.get(a, 0) >= 2
                b = largest(free, min(a if twice else a - 1, room - a))
                if b > 0 and a + b > best[0]:
                    best = (a + b, a, b)
                a = largest(free, a - 1)
            for n in best[1:] if best[1] else (small,):
                use[n] = use.get(n, 0) + 1
                if use[n] == left[n]:
                    free &= ~(1 << n)
            if not use[small]:
                del use[small]
            if not best[1]:
                break
            gap = room - best[0]
        copies = min(left[n] // k for n, k in use.items())
        plan.append((copies, use))
        for n, k in use.items():
            left[n] -= copies * k
            if not left[n]:
                present ^= 1 << n
    return plan


def addresses(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """The plan by (length, rank): which sequence and offset a piece of that rank gets."""
    rows, used, sequence = [], {}, 0
    for copies, use in plan:
        offset = 0
        for n in sorted(use, reverse=True):
            rows.append((n * RANKS + used.get(n, 0), used.get(n, 0), use[n], sequence, offset))
            used[n] = used.get(n, 0) + copies * use[n]
            offset += n * use[n]
        sequence += copies
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("key", "rank", "use", "sequence", "offset"), table.T.copy()))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Stored pieces with `sequence_id` and `offset` instead of `part` and `idx`."""
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = pieces.sparkSession.sparkContext.broadcast(addresses(plan_bins(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("idx"))
    kept = [c for c in pieces.columns if c not in ("part", "idx")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(p["key"], length * RANKS + rank, "right") - 1
            within = rank - p["rank"][at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept]
                + [
                    pa.array(p["sequence"][at] + within // p["use"][at]),
                    pa.array(p["offset"][at] + within % p["use"][at] * length),
                ],
                names=[*kept, "sequence_id", "offset"],
            )

    types = dict(pieces.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", sequence_id long, offset long"
    return map_batches(ranked.select(*kept, "rank"), place, schema)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """All documents in sequences of at most `capacity` tokens; see the module's text.

    Returns doc_id, piece, start, length, ids_crc32 (, ids), sequence_id, offset.
    """
    return pack_pieces(store(pieces_of(docs, tokenizer, capacity, keep_ids=keep_ids), "pieces"), capacity)
