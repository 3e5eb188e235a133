"""How near copies are compared in full, and which vectors are read for them."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tocsin.llm import near_dup
from tocsin.llm.shared import Tables


def test_dense_group_is_compared_by_blocks(spark, monkeypatch):
    """Several blocks of one home and of homes that meet: the links of all pairs, whatever the size of a block."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        words = list(base)
        for k in rng.sample(range(60), rng.choice([1, 2, 3])):
            words[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = spark.sparkContext.broadcast(near_dup.idf_table(docs))
    signed = near_dup.signatures(docs, idf)
    vectors = signed.select("node", "ids", "counts").dropDuplicates(["node"]).localCheckpoint()
    nodes = vectors.select("node")
    rows = near_dup.prefix_buckets(nodes, vectors, idf, 0.8).withColumn("label", F.col("node")).localCheckpoint()
    found = {}
    for size in (7, 10_000):
        monkeypatch.setattr(near_dup, "PACK", size)
        found[size] = {frozenset((bytes(r.a), bytes(r.b))) for r in near_dup.compared(rows, vectors, idf, 0.8).collect()}
    held = {bytes(r.node): near_dup.weighted(r.ids, r.counts, idf) for r in vectors.collect()}
    true = {frozenset((a, b)) for a in held for b in held if a < b and near_dup.similarity(held[a], held[b]) >= 0.8 - 1e-9}
    assert true and found[7] == found[10_000] == true


def test_marked_keeps_all_named_rows(spark):
    rows = spark.range(2000).selectExpr("cast(cast(id as string) as binary) node", "id")
    nodes = rows.where("id % 7 = 0").select("node")
    found = {r.id for r in near_dup.marked(rows, nodes).collect()}
    assert {i for i in range(2000) if i % 7 == 0} <= found and len(found) < 400


def test_packed_vectors_are_short_and_whole():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 500):
        ids = np.unique(rng.integers(0, 1 << near_dup.ID_BITS, n, np.uint64))
        raw = near_dup.packed(ids)
        assert near_dup.unpacked(raw, len(ids)).tolist() == ids.tolist()
        assert len(raw) <= 6 * len(ids)
    assert near_dup.unpacked(near_dup.packed(np.array([0, (1 << 44) - 1], np.uint64)), 2).tolist() == [0, (1 << 44) - 1]


def test_bucketed_table_is_not_shuffled_again(spark):
    tables = Tables(spark)
    rows = tables.bucketed(spark.range(1000).selectExpr("id AS node", "id * 2 AS twice"), "rows", "node")
    (name,), (path,) = tables.names.values(), tables.names
    joined = rows.hint("merge").join(spark.range(0, 1000, 3).withColumnRenamed("id", "node"), "node")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert joined.selectExpr("sum(twice - 2 * node)", "count(*)").first() == (0, 334)
    tables.close()
    assert not spark.catalog.tableExists(name) and not Path(path.removeprefix("file:")).exists()
