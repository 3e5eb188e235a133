"""Near-duplicate classes: consistent weighted samples of TF-IDF shingles, banded, verified exactly.

A text is the set of its five-word shingles (words: runs of ASCII letters and digits and of other
characters beyond ASCII, lower-cased; a shorter text is one shingle), each known by a 44-bit hash and
weighed by its count times an idf. The idf comes from the document frequencies of the whole corpus,
counted by hash bucket (BUCKETS of them; a bucket's count is the df of its shingles): 1 up to a share
COMMON of all documents, then falling with the logarithm of the share, to FLOOR at least. The floor
keeps large groups of near copies together, whose own shingles are frequent.

Improved consistent weighted sampling draws, for each of BANDS x ROWS hash functions, one (shingle,
level) of a text such that two texts draw the same with the probability of their weighted Jaccard
similarity. r, c ~ Gamma(2, 1) and beta ~ Uniform(0, 1) come from a table indexed by the shingle's hash;
the drawn one minimises ln c - r (floor(ln w / r + beta) - beta + 1), ties going to the smaller hash.
ROWS samples make a band; texts that share a band are candidates.

Candidates are never paired within a bucket. One text of each bucket (by hash) is compared with the others; links
(weighted Jaccard of THRESHOLD or more) join classes; then only buckets that still hold several classes go
on, with their next text, against texts of other classes. Texts that are still open after STAR_ROUNDS such rounds
go on by prefix instead: with a text's shingles in order of how many open texts hold them, rarest first, two texts of
similarity t share one of the first shingles of each that hold a share 1 - t of its weight. This is exact, and
shingles of a passage that many texts share come last. Texts that share such a shingle, and could be alike by their
total weights, are compared, by PREFIX_ROUNDS rounds of stars and then in full, so that every candidate pair is
verified, excluded by that bound or already in one class. In full, texts are dealt to blocks and each two blocks whose
texts may meet go to one task, so that a large group is copied once per block and its pairs are never rows.

Exact copies are one node (a SHA-256 of the text), collapsed before any shuffle by partial aggregation.

Defined results: null and empty texts are equal texts; texts without words are only like equal texts;
repeated rows are in one class; an empty table gives an empty result; other columns are ignored, and
`distinct_documents` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.shared import Tables, id_and_text, join_on, kept_by, map_batches, slices, store

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 4
BUCKETS = 1 << 19
COMMON = 0.01
FLOOR = 0.75
STAR_ROUNDS, PREFIX_ROUNDS = 2, 2  # rounds of stars over bands, then over prefixes
STEPS = 6  # classes of total weights from t w to w
HUB = 1_000  # pairs of one text that are verified together
PACK = 128  # texts of a block, about, when texts are compared in full
MARKS = 1 << 25  # bits of the filter of nodes
SLICE = 1 << 20  # bytes of text shingled together

ID_BITS = 44
TABLE = 1 << 16
BLOCK = 1 << 12  # buckets counted in one row

VECTOR = "ids binary, counts binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x (unsigned 64-bit)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Distinct shingles of many texts at once: hashes of words from running sums over all bytes."""

    def __init__(self):
        rng = np.random.default_rng(20)
        self.value = rng.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
        self.is_word = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
        base = int(rng.integers(1 << 62)) | 5
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def grow(self, size: int) -> None:
        if len(self.powers) < size:
            size = 1 << size.bit_length()
            for name, factor in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word and the number of its text."""
        raw = [t.lower().encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
        self.grow(len(data) + 1)
        inside = self.is_word[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.powers[: len(data)], dtype=np.uint64, out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * self.inverses[starts])
        firsts = np.cumsum([1] + [len(r) + 1 for r in raw])[:-1]
        return hashes, np.searchsorted(firsts, starts, "right") - 1

    def shingles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, shingle, count), by text and shingle; a shingle is a number of ID_BITS bits."""
        hashes, doc = self.words(texts)
        counts = np.bincount(doc, minlength=len(texts))
        wide = np.zeros(len(hashes), np.uint64)
        factor = np.uint64(0x9E3779B97F4A7C15)
        n = len(hashes) - WIDTH + 1
        for k in range(WIDTH if n > 0 else 0):
            wide[:n] = wide[:n] * factor + hashes[k : k + n]
        firsts = np.cumsum(counts) - counts
        short = np.flatnonzero((counts > 0) & (counts < WIDTH))
        last = np.repeat(firsts + counts, counts) if len(doc) else firsts
        whole = np.arange(len(hashes)) + WIDTH <= last if len(doc) else np.zeros(0, bool)
        for d in short.tolist():
            total = 0
            for h in hashes[firsts[d] : firsts[d] + counts[d]].tolist():
                total = (total * int(factor) + h) % (1 << 64)
            wide[firsts[d]], whole[firsts[d]] = total, True
        ids = mixed(wide[whole]) >> np.uint64(64 - ID_BITS)
        keys = np.sort((doc[whole].astype(np.uint64) << np.uint64(ID_BITS)) | ids)
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        counts = np.diff(np.append(new, len(keys)))
        keys = keys[new]
        return (keys >> np.uint64(ID_BITS)).astype(np.int64), keys & np.uint64((1 << ID_BITS) - 1), counts


def bucket_of(ids: np.ndarray) -> np.ndarray:
    return (ids & np.uint64(BUCKETS - 1)).astype(np.int64)


class Sampler:
    """Band values of weighted shingle sets."""

    def __init__(self):
        rng = np.random.default_rng(7)
        self.r = rng.gamma(2, 1, TABLE).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, TABLE)).astype(np.float32)
        self.beta = rng.random(TABLE).astype(np.float32)
        count = BANDS * ROWS
        self.salts = rng.integers(0, 1 << 63, count, np.uint64)
        self.factors = rng.integers(0, 1 << 63, count, np.uint64) | np.uint64(1)
        self.of_one = self.ordered(self.log_c - self.r * (1 - self.beta))  # where ln w is 0

    @staticmethod
    def ordered(x: np.ndarray) -> np.ndarray:
        """Floats as unsigned numbers of the same order, in the upper half of 64 bits."""
        bits = x.astype(np.float32).view(np.int32).astype(np.int64)
        return (np.where(bits < 0, ~bits, bits | (1 << 31)).astype(np.uint64) & np.uint64(0xFFFFFFFF)) << np.uint64(32)

    def bands(self, ids: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of BANDS values for each set; sets lie one after another and begin at `starts`."""
        hashes = mixed(ids + np.uint64(1))
        other = np.flatnonzero(weights != 1)
        log_w = np.log(weights[other]).astype(np.float32)
        out = np.zeros((len(starts), BANDS), np.uint64)
        for k, (salt, factor) in enumerate(zip(self.salts, self.factors, strict=True)):
            m = (hashes ^ salt) * factor
            at = (m >> np.uint64(48)).astype(np.int64)
            key = self.of_one[at]
            i = at[other]
            level = np.floor(log_w / self.r[i] + self.beta[i])
            key[other] = self.ordered(self.log_c[i] - self.r[i] * (level - self.beta[i] + 1))
            key |= m & np.uint64(0xFFFFFFFF)
            drawn = np.minimum.reduceat(key, starts)
            band = k // ROWS
            out[:, band] = mixed(out[:, band] * np.uint64(0x9E3779B97F4A7C15) + drawn + np.uint64(band + 1))
        return out


def tools() -> tuple[Shingler, Sampler]:
    """The worker's shingler and sampler, made once."""
    kept = kept_by("shingles")
    if not kept:
        kept.update(shingler=Shingler(), sampler=Sampler())
    return kept["shingler"], kept["sampler"]


def node_of(text: Column) -> Column:
    """What equal texts share: half of a SHA-256."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def small_slices(batches, size: int = SLICE):
    """Lists of rows with about `size` bytes of text each."""
    for batch in slices(batches):
        rows, held = [], 0
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            held += len(row[-1])
            if held >= size:
                yield rows
                rows, held = [], 0
        if rows:
            yield rows


def idf_table(docs: DataFrame) -> np.ndarray:
    """The idf of each hash bucket, from how many documents of the corpus hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, _ = tools()
        held, documents = np.zeros(BUCKETS, np.int32), 0
        for rows in small_slices(batches):
            doc, ids, _ = shingler.shingles([r[0] for r in rows])
            pairs = np.unique(doc * BUCKETS + bucket_of(ids))
            held += np.bincount(pairs % BUCKETS, minlength=BUCKETS).astype(np.int32)
            documents += len(rows)
        if documents:
            blocks = held.reshape(-1, BLOCK)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(blocks)), pa.int32()),
                    pa.array([documents] * len(blocks), pa.int64()),
                    pa.array([b.tobytes() for b in blocks], pa.binary()),
                ],
                ["block", "documents", "held"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for block, documents, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = sums.setdefault(block, [0, np.zeros(BLOCK, np.int64)])
                total[0] += documents
                total[1] += np.frombuffer(held, np.int32)
        rows = []
        for block, (documents, held) in sums.items():
            for i in np.flatnonzero(held > COMMON * documents).tolist():
                rows.append((block * BLOCK + i, held[i] / documents))
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in rows], pa.int32()), pa.array([s for _, s in rows], pa.float64())],
            ["bucket", "share"],
        )

    counted = map_batches(docs.select("text"), count, "block int, documents long, held binary")
    shares = map_batches(counted.repartition("block"), add, "bucket int, share double").collect()
    table = np.ones(BUCKETS, np.float32)
    for r in shares:  # at most as many as there are buckets
        table[r["bucket"]] = max(FLOOR, np.log(1 / r["share"]) / np.log(1 / COMMON))
    return table


def signatures(docs: DataFrame, idf) -> DataFrame:
    """doc_id, node, bands and the shingles with counts of every document; `idf`: broadcast table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sampler = tools()
        for rows in small_slices(batches):
            doc, ids, counts = shingler.shingles([r[2] for r in rows])
            filled, starts = np.unique(doc, return_index=True)
            bands: list[list[int]] = [[] for _ in rows]
            vectors: list[tuple[bytes, bytes]] = [(b"", b"")] * len(rows)
            if len(starts):
                drawn = sampler.bands(ids, counts * idf.value[bucket_of(ids)], starts)
                ends = np.append(starts[1:], len(ids))
                for d, i, j, own in zip(filled.tolist(), starts.tolist(), ends.tolist(), drawn.view(np.int64).tolist()):
                    bands[d] = own
                    vectors[d] = packed(ids[i:j]), counts[i:j].astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array([a for a, _ in vectors], pa.binary()),
                    pa.array([b for _, b in vectors], pa.binary()),
                ],
                ["doc_id", "node", "bands", "ids", "counts"],
            )

    with_node = docs.select("doc_id", node_of(F.col("text")).alias("node"), "text")
    return map_batches(with_node, run, f"doc_id long, node binary, bands array<long>, {VECTOR}")


def packed(ids: np.ndarray) -> bytes:
    """Sorted shingles as the steps between them: the lowest byte of each, then the next, as many as the widest takes."""
    steps = np.diff(ids, prepend=np.uint64(0)).astype("<u8")
    width = -(-int(steps.max(initial=0)).bit_length() // 8)
    return steps.view(np.uint8).reshape(-1, 8)[:, : max(width, 1)].T.tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    if n:
        steps[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(-1, n).T
    return np.cumsum(steps.view("<u8").reshape(-1), dtype=np.uint64)


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two (ids, weights, total)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = np.flatnonzero(b[0][at] == a[0])
    both = float(np.minimum(a[1][same], b[1][at[same]]).sum())
    return both / (a[2] + b[2] - both)


def weighted(ids: bytes, counts: bytes, idf) -> tuple[np.ndarray, np.ndarray, float]:
    """Shingles, their weights and the sum of these, of a stored vector."""
    numbers = unpacked(ids, len(counts) // 4)
    weights = np.frombuffer(counts, np.uint32) * idf.value[bucket_of(numbers)].astype(np.float64)
    return numbers, weights, float(weights.sum())


def verified(pairs: DataFrame, vectors: DataFrame, idf, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes whose similarity reaches the threshold.

    A text with many partners is dealt to parts of about HUB pairs; its vector comes once to each part, ahead of
    its partners' vectors, and is never copied into pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mine = None, None
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            names = ("a", "part", "b", "ids", "counts")
            for a, part, b, ids, counts in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if b is None:
                    own, mine = (a, part), weighted(ids, counts, idf)
                elif own == (a, part) and similarity(mine, weighted(ids, counts, idf)) >= threshold - 1e-9:
                    found.append((a, b))
            columns = [pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    hubs = pairs.groupBy("a").agg((1 + F.floor(F.count(F.lit(1)) / HUB)).alias("parts"))
    dealt = pairs.join(hubs.where("parts > 1"), "a", "left")
    dealt = dealt.select("a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"), "b")
    theirs = dealt.join(vectors.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "ids", "counts")
    own = hubs.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    own = own.join(vectors.withColumnRenamed("node", "a"), "a")
    own = own.select("a", "part", F.lit(None).cast("binary").alias("b"), "ids", "counts")
    both = own.unionByName(theirs).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return map_batches(both, run, "a binary, b binary")


def components(tables: Tables, links: DataFrame) -> DataFrame:
    """Stored (node, label) of linked nodes: the least node of each connected component.

    Every node takes the least label among its neighbours, then its label's label, until none changes.
    """
    edges = tables.store(links.union(links.select("b", "a")).toDF("node", "other").distinct(), "edges")
    labels = tables.store(edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        theirs = labels.select(F.col("node").alias("other"), F.col("label").alias("theirs"))
        near = edges.join(theirs, "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "theirs").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("jump"))
        after = lower.join(jump, "new").select(
            "node", F.least("new", "jump").alias("label"), (F.least("new", "jump") < F.col("label")).alias("moved")
        )
        after = tables.store(after, "labels")
        tables.drop(labels)
        labels = after
        if after.where("moved").isEmpty():
            tables.drop(edges)
            return after


def joined(tables: Tables, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Stored (node, label) after new links; labels of nodes without links are the nodes themselves."""
    of_a, of_b = (labels.select(F.col("node").alias(n), F.col("label").alias(f"{n}_label")) for n in "ab")
    ends = links.join(of_a, "a", "left").join(of_b, "b", "left")
    ends = ends.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a <> b")
    moves = components(tables, ends)
    nodes = links.select("a").union(links.select("b")).toDF("node").join(labels, "node", "left_anti").distinct()
    known = labels.union(nodes.select("node", F.col("node").alias("label")))
    moved = moves.select(F.col("node").alias("label"), F.col("label").alias("moved"))
    found = tables.store(known.join(moved, "label", "left").select("node", F.coalesce("moved", "label").alias("label")), "labels")
    tables.drop(moves, labels)
    return found


def prefix_buckets(nodes: DataFrame, vectors: DataFrame, idf, threshold: float) -> DataFrame:
    """(band, node, total, heavy) of open nodes, by shingles of their prefixes that other open nodes hold as well.

    Of two texts of similarity t and total weights v <= w, the common weight is at least t / (1 + t) (v + w), so their
    first common shingle lies where less than the rest of that is before it: for the lighter text, within a share
    1 - 2 t / (1 + t) of its weight; for the heavier one, within 1 - t / (1 + t) (1 + v / w) of its own. Weights are
    cut to classes, STEPS of them from t w to w, which bounds v / w from below. A bucket is a shingle and a class: the
    lighter texts of the class, and the heavier ones (`heavy`) of it and of the classes above that reach it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, ids, counts in zip(*(batch.column(c).to_pylist() for c in ("node", "ids", "counts")), strict=True):
                shingles, weights, total = weighted(ids, counts, idf)
                columns = [
                    pa.array([node] * len(shingles), pa.binary()),
                    pa.array(shingles.view(np.int64), pa.int64()),
                    pa.array(weights, pa.float64()),
                    pa.array(np.full(len(shingles), total), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["node", "shingle", "weight", "total"])

    open_vectors = vectors.join(nodes, "node", "left_semi").select("node", "ids", "counts")
    rows = map_batches(open_vectors, run, "node binary, shingle long, weight double, total double")
    holders = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders"))
    place = Window.partitionBy("node").orderBy("holders", "shingle").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(holders, "shingle").withColumn("share", (F.sum("weight").over(place) - F.col("weight")) / F.col("total"))
    step = threshold ** (1 / STEPS)
    own = F.floor(F.log("total") / -np.log(step))
    part, more = threshold / (1 + threshold), 1e-9
    lighter = F.struct(F.lit(False).alias("heavy"), F.lit(0).alias("below"), F.lit(1 - 2 * part + more).alias("within"))
    heavier = [
        # one class more than STEPS, as the logarithm may be rounded
        F.struct(F.lit(True).alias("heavy"), F.lit(k).alias("below"), F.lit(1 - part * (1 + step ** (k + 1)) + more).alias("within"))
        for k in range(STEPS + 2)
    ]
    dealt = placed.where(f"holders > 1 AND share <= {1 - threshold + 2 * more}")
    dealt = dealt.select("node", "total", "shingle", "share", own.alias("own"), F.inline(F.array(lighter, *heavier)))
    band = F.xxhash64("shingle", F.col("own") - F.col("below"))
    return dealt.where("share <= within").select(band.alias("band"), "node", "total", "heavy")


def compared(several: DataFrame, vectors: DataFrame, idf, threshold: float) -> DataFrame:
    """Links (a, b) between all texts of different classes that are, one heavy and one not, in one bucket.

    A text's home is its most crowded bucket. Homes are cut to blocks of about PACK texts. Each two blocks of homes
    that a bucket has in common are a unit: their texts come to it once each, with their vectors and buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []
        names = ("unit", "side", "node", "label", "total", "lights", "heavies", "ids", "counts")
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if row[0] != unit:
                    yield linked(held)
                    unit, held = row[0], []
                held.append((row[1], row[2], row[3], row[4], set(row[5]), set(row[6]), row[7], row[8]))
        yield linked(held)

    def linked(held: list[tuple]) -> pa.RecordBatch:
        found, weights = [], {}

        def own(k: int) -> tuple:
            if k not in weights:
                weights[k] = weighted(held[k][6], held[k][7], idf)
            return weights[k]

        for i, (side, node, label, total, lights, heavies, _, _) in enumerate(held):
            for j in range(i + 1, len(held)):
                other = held[j]
                if label == other[2] or side == other[0] != 2 or min(total, other[3]) < threshold * max(total, other[3]) * (1 - 1e-9):
                    continue
                if lights.isdisjoint(other[5]) and heavies.isdisjoint(other[4]):
                    continue
                if similarity(own(i), own(j)) >= threshold - 1e-9:
                    found.append((node, other[1]))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["a", "b"])

    sizes = several.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    places = several.join(sizes, "band").groupBy("node").agg(
        F.max(F.struct("n", "band"))["band"].alias("home"), F.min("label").alias("label"), F.min("total").alias("total"),
        F.collect_set(F.when(~F.col("heavy"), F.col("band"))).alias("lights"),
        F.collect_set(F.when(F.col("heavy"), F.col("band"))).alias("heavies"),
    )
    parts = places.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("parts"))
    homes = several.select("band", "node").join(places.select("node", "home"), "node").groupBy("band")
    homes = homes.agg(F.sort_array(F.collect_set("home")).alias("homes")).select("homes").distinct()
    meet = homes.select(F.explode("homes").alias("one"), "homes").select("one", F.explode("homes").alias("two")).where("one <= two").distinct()
    meet = meet.join(parts.toDF("one", "ones"), "one").join(parts.toDF("two", "twos"), "two")
    meet = meet.select("one", "two", "twos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ones") - 1)).alias("i"))
    meet = meet.select("one", "two", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("twos") - 1)).alias("j"))
    meet = meet.where("one < two OR i <= j").withColumn("unit", F.concat_ws(" ", "one", "i", "two", "j"))
    # side 2: a block with itself; texts of one block are compared there alone
    same = (F.col("one") == F.col("two")) & (F.col("i") == F.col("j"))
    sides = F.when(same, F.array(F.struct(F.lit(2).alias("side"), F.col("one").alias("home"), F.col("i").alias("part")))).otherwise(
        F.array(
            F.struct(F.lit(0).alias("side"), F.col("one").alias("home"), F.col("i").alias("part")),
            F.struct(F.lit(1).alias("side"), F.col("two").alias("home"), F.col("j").alias("part")),
        )
    )
    blocks = meet.select("unit", F.inline(sides))
    texts = places.join(parts, "home").withColumn("part", F.pmod(F.xxhash64("node"), "parts")).drop("parts")
    texts = texts.join(vectors, "node").join(blocks, ["home", "part"]).drop("home", "part")
    return map_batches(texts.repartition("unit").sortWithinPartitions("unit"), run, "a binary, b binary").distinct()


def marked(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows whose node is among `nodes`, and a few others: by a bitmap of MARKS bits, whatever the input's size."""
    mark = F.pmod(F.xxhash64("node"), F.lit(MARKS))
    word, bit = F.floor(mark / 32768), mark % 32768  # as many bits has a bitmap
    maps = nodes.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("word", word).join(F.broadcast(maps), "word")
    return found.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)


def open_of(tables: Tables, rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored rows of buckets that hold several classes, with the label of each node and the bucket's first node."""
    classed = tables.store(rows.join(labels, "node", "left").select(*rows.columns, F.coalesce("label", "node").alias("label")), "classed")
    per_band = classed.groupBy("band").agg(
        # another text in each bucket, so that a text that is in many meets many others
        F.min(F.struct(F.xxhash64("node", "band").alias("turn"), "node", "label", "total")).alias("first"),
        F.min("label").alias("low"), F.max("label").alias("high"),
    )
    several = tables.store(classed.join(per_band.where("low < high").select("band", "first"), "band"), "several")
    tables.drop(classed)
    return several


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Stored (doc_id, node, label): documents of one near-duplicate class have one label."""
    texts = id_and_text(docs)
    spark = docs.sparkSession
    tables = Tables(spark)
    idf = spark.sparkContext.broadcast(idf_table(texts))
    signed = tables.store(signatures(texts, idf), "signatures")
    nodes = signed.select("node", "bands").dropDuplicates(["node"])
    rows = nodes.select(F.explode("bands").alias("band"), "node")
    crowded = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    # no total is known yet: nothing is excluded by it
    open_rows = rows.join(crowded, "band").withColumns({"total": F.lit(0.0), "heavy": F.lit(False)})
    open_rows = tables.store(open_rows, "buckets")
    candidates = open_rows.select("node").distinct()
    # no semi-join here: that would be planned below the filter, and all vectors shuffled
    vectors = marked(signed.select("node", "ids", "counts"), candidates).join(candidates, "node").dropDuplicates(["node"])
    vectors = tables.bucketed(vectors, "vectors", "node")  # every round joins them, twice
    labels = tables.store(spark.range(0).select(*[F.lit(b"").alias(c) for c in ("node", "label")]), "labels")
    could = F.least("total", "first.total") >= threshold * F.greatest("total", "first.total") * (1 - 1e-9)
    kept = open_rows
    for by_prefix in (False, True):
        if by_prefix:
            still = several.select("node").distinct()
            rows = tables.store(prefix_buckets(still, vectors, idf, threshold), "prefixes")
            tables.drop(several, kept)
            kept = rows
        rounds = PREFIX_ROUNDS if by_prefix else STAR_ROUNDS
        for number in range(rounds + by_prefix):
            several = open_of(tables, kept, labels)
            tables.drop(kept)
            if number < rounds:
                pairs = several.where("label <> first.label").where(could).select(F.col("first.node").alias("a"), F.col("node").alias("b"))
                pairs = tables.store(pairs.distinct(), "pairs")
                links = tables.store(verified(pairs, vectors, idf, threshold), "links")
                tables.drop(pairs)
                kept = tables.store(several.where("node <> first.node").select("band", "node", "total", "heavy"), "open")
            else:
                links, kept = tables.store(compared(several, vectors, idf, threshold), "links"), None
            labels = joined(tables, labels, links)
            tables.drop(links, several)
        if not by_prefix:
            several = open_of(tables, kept, labels)
    found = signed.select("doc_id", "node").join(labels, "node", "left")
    found = store(found.select("doc_id", "node", F.coalesce("label", "node").alias("label")), "classes")
    tables.close()
    return found


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and class_size of every document."""
    found = classes(docs, threshold)
    named = found.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return found.join(named, "label").select("doc_id", "class_id", "class_size")


def distinct_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the least doc_id, with the columns it came with."""
    found = classes(docs, threshold)
    first = found.groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("first")).select("first.*")
    # the row travels as one struct, so that its columns' names can't clash with these
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node_of(F.col("text")).alias("node"), F.struct("*").alias("row"))
    own = own.dropDuplicates(["doc_id", "node"])
    return join_on(own, first, ["doc_id", "node"], "left_semi").select("l.row.*")
