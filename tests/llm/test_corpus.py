"""Operators that look at the whole table, against brute force."""

from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin.llm import near_dup, sharding, topk

VECTORS = "vec_id long, embedding array<float>"


@pytest.fixture(params=["awkward", "sample", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def clashing(docs, *names):
    return docs.withColumns({n: F.lit(1) for n in names})


# sharding ------------------------------------------------------------------


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_sharding(docs, shards):
    got = sharding.shard(clashing(docs, "place", "shard", "size", "row"), shards).collect()
    by_text = defaultdict(set)
    sizes, slots = Counter(), defaultdict(list)
    held = {(i, len((t or "").encode()) + 8) for i, t in texts(docs)}
    assert len(got) == docs.count()
    for r in got:
        assert (r["doc_id"], r["size"]) in held and 0 <= r["shard"] < shards
        by_text[r["text_crc32"], r["size"]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_capacity_is_the_least(spark, sample, monkeypatch):
    # few segments at first, so that the bounds have to be refined
    monkeypatch.setattr(sharding, "RESOLUTION", 16)
    monkeypatch.setattr(sharding, "FINER", 4)
    rows = sharding.sized(sample)
    alone, cuts = sharding.shard_map(rows, 24)
    groups = [(r["place"], r["n"]) for r in rows.groupBy("place").agg(F.sum("size").alias("n")).collect()]
    rest = sorted(g for g in groups if g[0] not in alone)
    shards = Counter()
    for place, n in rest:
        shards[sum(place >= c for c in cuts)] += n
    left = 24 - len(alone)
    assert max(shards.values()) == sharding.largest([n for _, n in rest], left)
    assert max(shards.values()) <= sum(n for _, n in rest) / left + max(n for _, n in rest)


def test_a_group_of_a_third_has_its_own_shard(spark):
    rows = [(i, "the same" if i % 3 == 0 else f"text {i}" * 3) for i in range(900)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    own = {r["shard"] for r in got if r["doc_id"] % 3 == 0}
    rest = [n for s, n in sizes.items() if s not in own]
    assert len(own) == 1 and len(rest) == 5 and max(rest) - min(rest) <= 100


# exact search --------------------------------------------------------------


def best(rows, k, is_query):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all():
            usable[i] = np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)
    out = set()
    for q, x in usable.items():
        if is_query(q):
            scored = sorted((-int(x @ y), o) for o, y in usable.items() if o != q)
            out |= {(q, n, o, -s) for n, (s, o) in enumerate(scored[:k], 1)}
    return out


def ranked(df):
    return [tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()]


@pytest.mark.parametrize("block, part", [(16_384, 16_384), (7, 40)])
def test_search(spark, monkeypatch, block, part):
    monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
    monkeypatch.setattr(topk, "PART_ROWS", part)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.1).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[10][1]) for i in range(150)]  # a third are equal
    rows += [(i, [0.0] * 8) for i in (600, 605, 610)]
    rows += [(700, None), (705, [None] * 8), (710, [float("nan")] * 8), (715, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [rows[0], rows[20]]
    df = clashing(spark.createDataFrame(rows, VECTORS).repartition(5), "cell", "vector", "score", "rank")
    got = ranked(topk.top_k(df, F.col("vec_id") % 5 == 0, pivot_count=8))
    assert len(got) == len(set(got))
    assert set(got) == best(rows, 5, lambda q: q % 5 == 0)


def test_search_replicates_only_what_may_count(spark, monkeypatch):
    # far clusters: a group of queries needs its own cluster's vectors only
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(topk, "PART_ROWS", 40)
    rng = np.random.default_rng(4)
    angle = np.arange(8) * np.pi / 4
    centres = np.stack([np.cos(angle), np.sin(angle)], 1) * 50
    rows = [(i, (centres[i % 8] + rng.normal(size=2) * 0.01).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, VECTORS)
    numbers = topk.quantized(df, "vec_id", "embedding")
    left, right = topk.sides(numbers, 2, F.col("vec_id") < 8, 5, 64)
    blocks = left.select("block").distinct().count()
    assert 400 <= right.count() < 400 * blocks / 2  # each vector to few of the blocks
    filled = Counter((r["block"], r["part"]) for r in right.collect())
    assert {(r["block"], r["part"]) for r in left.collect()} >= set(filled)
    assert left.count() <= 8 * 11  # parts by what reaches a block, not by all data
    got = topk.top_k(df, F.col("vec_id") < 8, pivot_count=64)
    assert set(ranked(got)) == best(rows, 5, lambda q: q < 8)


def test_search_of_few_and_none(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert ranked(topk.top_k(empty, F.col("vec_id") % 50 == 0)) == []
    one = spark.createDataFrame([(0, [1.0, 2.0])], VECTORS)
    assert ranked(topk.top_k(one, F.col("vec_id") % 50 == 0)) == []
    two = spark.createDataFrame([(0, [1.0, 2.0]), (3, [-1.0, 0.001])], VECTORS)
    assert ranked(topk.top_k(two, F.col("vec_id") % 50 == 0)) == [(0, 1, 3, -256 * 256 + 0)]
    none = spark.createDataFrame([(1, [1.0, 2.0]), (3, [-1.0, 0.5])], VECTORS)
    assert ranked(topk.top_k(none, F.col("vec_id") % 50 == 0)) == []


@pytest.mark.parametrize("size", [10.0**6, 2.0**23, 8e6, 1e9, 2.0**45])
def test_search_of_large_components(spark, size):
    rng = np.random.default_rng(6)
    rows = [(i, [size - i, -size, float(i), *(rng.choice([-1, 1], 5) * size / 2).tolist()]) for i in range(40)]
    rows += [(100 + i, [float(i)] * 8) for i in range(20)]
    schema = "vec_id long, embedding array<double>"
    got = topk.top_k(spark.createDataFrame(rows, schema).repartition(3), F.col("vec_id") % 10 == 0)
    numbers = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows}  # Python's numbers, of any size
    want = set()
    for q in (i for i in numbers if i % 10 == 0):
        scored = sorted((-sum(a * b for a, b in zip(numbers[q], numbers[o])), o) for o in numbers if o != q)
        want |= {(q, n, o, -s if -(2**63) <= -s < 2**63 else None, -s) for n, (s, o) in enumerate(scored[:5], 1)}
    found = {(r["query_id"], r["rank"], r["vec_id"], r["score"], int(r["exact"])) for r in got.collect()}
    assert found == want and all(int(r["exact"]) == r["score"] for r in got.collect() if r["score"] is not None)


def test_far_from_the_origin_and_close_together(spark):
    # rounding in distances is larger than the distances
    rng = np.random.default_rng(8)
    rows = [(i, (1e6 + rng.normal(size=8) * 0.01).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    numbers = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows}
    want = set()
    for q in range(0, 300, 20):
        scored = sorted((-sum(a * b for a, b in zip(numbers[q], numbers[o])), o) for o in numbers if o != q)
        want |= {(q, n, o, -s) for n, (s, o) in enumerate(scored[:5], 1)}
    assert set(ranked(topk.top_k(df, F.col("vec_id") % 20 == 0))) == want


def test_left_out_says_why(spark):
    inf = float("inf")
    rows = [(1, [1.0, 2.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [None, 1.0]), (6, [inf, 1.0]), (7, [1e300, 0.0])]
    rows += [(8, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["reason"] for r in topk.left_out(df).collect()}
    assert got == {
        3: "no vector", 4: "no vector", 5: "not finite", 6: "not finite", 7: "too large", 8: "other length", None: "no id",
    }
    assert ranked(topk.top_k(df, F.col("vec_id") == 1)) == [(1, 1, 2, 2 * 65536)]
    assert topk.left_out(df.limit(0)).count() == 0


def test_search_of_the_sample(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert set(ranked(topk.top_k(df, F.col("vec_id") % 50 == 0))) == best(rows, 5, lambda q: q % 50 == 0)


# near duplicates -----------------------------------------------------------


class Idf:
    """A broadcast table as the functions on workers see it."""

    def __init__(self, value):
        self.value = value


def links_of(items, idf, threshold=0.8):
    """Node pairs at or above the threshold, by the operator's own hashes but over all pairs."""
    shingler = near_dup.Shingler()
    vectors = {}
    for name, text in items.items():
        _, ids, counts = shingler.shingles([text or ""])
        w = counts * idf[near_dup.bucket_of(ids)].astype(float)
        vectors[name] = dict(zip(ids.tolist(), w.tolist(), strict=True))
    names = sorted(vectors)
    held = defaultdict(list)
    for n in names:
        for s in vectors[n]:
            held[s].append(n)
    near = {(a, b) for group in held.values() for i, a in enumerate(group) for b in group[i + 1 :]}
    return {p for p in near if brute.weighted_jaccard(vectors[p[0]], vectors[p[1]]) >= threshold - 1e-9}


def joined(names, links):
    label = {n: n for n in names}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in names}


def variants(seed=0, families=12, copies=9, length=120):
    """Families of texts with a few words changed, in chains, beside unrelated ones."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(families):
        text = rng.choice(words, length).tolist()
        for _ in range(copies):
            out.append(" ".join(text))
            text = list(text)
            for i in rng.integers(0, length, rng.integers(0, 4)):
                text[i] = rng.choice(words)
    out += [" ".join(rng.choice(words, length)) for _ in range(30)]
    return out


@pytest.mark.parametrize("stars", [0, 1, 4])
def test_near_duplicates_of_families(spark, monkeypatch, stars):
    monkeypatch.setattr(near_dup, "STAR_ROUNDS", stars)
    rows = list(enumerate(variants()))
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "node", "label", "bands")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(df).collect()}
    idf = near_dup.idf_table(df)
    links = links_of(dict(rows), idf)
    assert 60 < len(links)
    assert got == joined([i for i, _ in rows], links)


def test_near_duplicates_of_documents(docs):
    found = near_dup.near_duplicates(clashing(docs, "node", "class_id", "count"))
    got = Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in found.collect())
    given = texts(docs)
    unique = sorted({t or "" for _, t in given})
    idf = near_dup.idf_table(docs.select("text").fillna(""))
    label = joined(range(len(unique)), links_of(dict(enumerate(unique)), idf))
    number = {t: label[i] for i, t in enumerate(unique)}
    members = defaultdict(list)
    for i, t in given:
        members[number[t or ""]].append(i)
    expected = Counter()
    for i, t in given:
        own = members[number[t or ""]]
        expected[i, min((x for x in own if x is not None), default=None), len(own)] += 1
    assert got == expected


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(2000)]
    base = rng.choice(words, 200).tolist()
    rows = []
    for i in range(600):
        text = list(base) if i % 3 == 0 else rng.choice(words, 200).tolist()
        text[int(rng.integers(200))] = "changed"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(df).collect()}
    assert {got[i] for i in range(0, 600, 3)} == {0}
    assert all(got[i] == i for i in range(600) if i % 3)


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(1)
    sampler = near_dup.Sampler()
    a = np.sort(rng.choice(1 << 43, 400, replace=False)).astype(np.uint64)
    wa = rng.choice([1.0, 0.8, 2.0, 3.0], 400)
    b, wb = a.copy(), wa.copy()
    b[:30] += np.uint64(1 << 42)
    wb[30:60] *= 1.7
    order = np.argsort(b)
    b, wb = b[order], wb[order]
    wanted = brute.weighted_jaccard(dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb)))
    agreed = []
    for turn in range(40):
        sampler.salts = rng.integers(0, 1 << 63, len(sampler.salts), np.uint64)
        sampler.factors = rng.integers(0, 1 << 63, len(sampler.salts), np.uint64) | np.uint64(1)
        x, y = (sampler.bands(i, w, np.array([0]))[0] for i, w in ((a, wa), (b, wb)))
        agreed.append(np.mean(x == y))
    assert abs(np.mean(agreed) - wanted**near_dup.ROWS) < 0.05


def test_distinct_documents(docs):
    wide = clashing(docs, "node", "label", "__x")
    kept = near_dup.distinct_documents(wide)
    assert kept.columns == wide.columns
    classes = near_dup.classes(docs).select("label").distinct().count()
    assert kept.count() == classes
    assert {r["doc_id"] for r in kept.collect()} == {r["class_id"] for r in near_dup.near_duplicates(docs).collect()}


def test_idf_falls_with_the_share_of_documents(spark):
    rows = [(i, "one two three four five" if i % 2 else f"{i} b{i} c{i} d{i} e{i}") for i in range(400)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    table = near_dup.idf_table(df)
    _, ids, _ = near_dup.Shingler().shingles(["one two three four five", "0 b0 c0 d0 e0"])
    common, rare = table[near_dup.bucket_of(ids)]
    assert common == near_dup.FLOOR and rare == 1
