"""The pipeline's stages against plain restatements, each on what the stage before it kept."""

from collections import Counter

import brute
import corpus_pipeline
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tocsin.llm import near_dup, packing, quality, toxicity
from tocsin.llm.shared import store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF), name.replace(" ", "-"))
        out.append(docs)
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns_and_names(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality rules", "near-dedup", "secret scans", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_toxic_documents_go(spark, stages):
    judged = toxicity.judged(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(stages[1]) == ids(judged.where("predicted = 0"))


def test_rejected_documents_go(stages):
    kept = ids(stages[2])
    for r in stages[1].collect():
        failed = brute.quality_row(r["text"])[-1]
        assert not (failed and r["doc_id"] in kept)
    assert kept == ids(quality.measured(stages[1]).where("kept"))


def test_one_document_of_each_class_stays(stages):
    found = near_dup.near_duplicates(stages[2]).collect()
    assert ids(stages[3]) == {r["class_id"] for r in found}


def test_secrets_are_masked_and_the_rest_is_as_it_was(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    for r in stages[4].collect():
        assert not [x for x in brute.secrets(r["text"]) if "[SECRET]" not in r["text"][x[0] : x[3]]]
        if not brute.secrets(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
    assert ids(stages[4]) == set(before)


def test_everything_kept_is_packed(stages):
    tokenizer = Tokenizer.from_file(P.path(packing.TOKENIZER))
    expected = Counter()
    for r in stages[4].collect():
        for piece in brute.pieces(tokenizer.encode(r["text"], add_special_tokens=False).ids):
            expected[r["doc_id"], *piece] += 1
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in stages[5].collect())
    assert got == expected


def test_run_gives_what_the_stages_give(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    again = Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).select(*columns).collect())
    assert again == Counter(tuple(r) for r in stages[-1].select(*columns).collect())


def test_an_empty_table_goes_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF), "empty")
        assert docs.count() == 0
