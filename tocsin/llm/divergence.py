"""Source divergence audit: how far the words of each source of a language lie from those of the others.

Each language's terms are split by hash into slices of about SLICE_TERMS distinct terms, and a CountVectorizer with
minDF and the largest integer as vocabSize is fitted on each slice: its vocabulary is what passes through the driver
and is broadcast, and the slices bound it however large the language's vocabulary grows, without leaving a term out.
The vectors are exact and sparse. Their sums per source are sums of whole numbers per (source, index), aggregated
before the shuffle (ml.stat.Summarizer keeps means in dense arrays, which are neither exact nor sparse).

A pair of sources g, h of one language is evaluated sparsely. With f0 the value of a term that neither has, a term's
value differs from f0 only where one of them has it:

    value(g, h) = V f0 + sum over g's terms [f(p, q0) - f0] + sum over h's terms [f(p0, q) - f0]
                + sum over common terms [f(p, q) - f(p, q0) - f(p0, q) + f0]

The two middle sums need only how many terms of a source have which count. The last one is worked out in blocks of
BLOCK_TERMS terms with the sources that hold them, in numpy, and summed per pair. All numbers are whole: quotients of
1e9 (count + 1) are taken of 128-bit decimals, and the value of a pair is below (1e9 + V) squared.

Defined results: null text, lang and source are ''; a term counts in its document each time it stands there; repeated
rows are documents of their own; a language whose documents share no term often enough has V = 0, pairs of value 0 and
no terms; a language of one source has no pairs; an empty table gives an empty result; other columns are ignored.
The driver holds the list of languages, with three numbers each, and runs the slices of each in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.shared import new_folder, ship_package, store

MIN_DF = 3
VOCAB_SIZE = 2**31 - 1
SLICE_TERMS = 1 << 21
ONE_IN = 64  # distinct terms are estimated from so small a share of all hash values
BLOCK_TERMS = 1 << 12
TOP_TERMS = 200
SCALE = 10**9
LARGE = 2**63 // SCALE - 1  # counts below, and one more, times SCALE are longs
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PRESENT = ""  # a term of every document, so that no vocabulary is empty; no text has it


def lowered(text: Column) -> Column:
    """Only A-Z in lower case; `lower` does so, far faster, where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))


def terms_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), SEPARATORS), "")


def rows_of(docs: DataFrame) -> DataFrame:
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    # documents of a source side by side, so that a task sends the counts of few sources; large sources are split
    plain = docs.select(*plain).hint("rebalance", "lang", "source")
    return plain.select("lang", "source", F.concat(terms_of(F.col("text")), F.array(F.lit(PRESENT))).alias("terms"))


def folder_of(lang: Column) -> Column:
    """A language as the value of a partition column: no text is empty or escaped there."""
    return F.concat(F.lit("x"), F.hex(lang))


def languages(rows: DataFrame, slice_terms: int) -> list[tuple[str, int, int]]:
    """(folder, documents, slices) of each language of the stored rows."""
    sizes = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    counted = rows.select("folder", F.explode("terms").alias("term")).where(F.pmod(F.xxhash64("term"), F.lit(ONE_IN)) == 0)
    spoken = counted.groupBy("folder").agg((F.approx_count_distinct("term") * ONE_IN).alias("terms"))
    found = sizes.join(spoken, "folder", "left").select("folder", "n", F.coalesce("terms", F.lit(0)).alias("terms"))
    return sorted((r["folder"], r["n"], 1 + r["terms"] // slice_terms) for r in found.collect())


def sliced(rows: DataFrame, slices: int, path: str) -> list[DataFrame]:
    """The rows with the terms of one slice each, every slice in a folder of its own."""
    if slices == 1:
        return [rows]
    number = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    own = F.filter("terms", lambda t: (F.pmod(F.xxhash64(t), F.lit(slices)) == F.col("slice")) | (t == PRESENT))
    rows.select("source", "terms", number).select("slice", "source", own.alias("terms")).write.partitionBy("slice").option(
        "compression", "zstd"
    ).parquet(path)
    schema = "source string, terms array<string>"
    return [rows.sparkSession.read.schema(schema).parquet(f"{path}/slice={s}") for s in range(slices)]


def vectorized(docs: DataFrame, slice_terms: int = SLICE_TERMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, terms, groups) of all languages, stored.

    counts: lang, slice, source, index, count of each kept term in each source that has it; terms: lang, slice,
    index, term of each kept term; groups: lang and source of each group of documents.
    """
    spark, path = docs.sparkSession, new_folder(docs.sparkSession, "divergence")
    rows = rows_of(docs).withColumn("folder", folder_of(F.col("lang")))
    rows.write.partitionBy("folder").option("compression", "zstd").parquet(f"{path}/rows")
    schema = "lang string, source string, terms array<string>, folder string"
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    groups = store(rows.select("folder", "lang", "source").distinct(), "groups")
    found = [("counts", "source string, index int, count long"), ("terms", "term string, index int")]
    for name, columns in found:  # so that there is a table even where no language has enough documents
        none = spark.range(0).select(*[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns.split(", ")])
        none.write.parquet(f"{path}/{name}/folder=x/slice=0")
    for folder, n, slices in languages(rows, slice_terms):
        if n < MIN_DF:
            continue
        own = spark.read.schema("source string, terms array<string>").parquet(f"{path}/rows/folder={folder}")
        for s, documents in enumerate(sliced(own, slices, f"{path}/sliced/folder={folder}")):
            vectorize(documents, f"{path}/%s/folder={folder}/slice={s}")
    langs = groups.select("folder", "lang").distinct()
    counts, terms = (
        spark.read.schema(f"folder string, slice int, {columns}").parquet(f"{path}/{name}").join(langs, "folder")
        for name, columns in found
    )
    return counts.drop("folder"), terms.drop("folder"), groups.drop("folder")


def vectorize(documents: DataFrame, path: str) -> None:
    """Write the counts per source and the vocabulary of one slice of a language under `path`."""
    spark = documents.sparkSession
    model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(MIN_DF), vocabSize=VOCAB_SIZE).fit(documents)
    vocabulary = pd.DataFrame({"term": model.vocabulary})
    vocabulary["index"] = np.arange(len(vocabulary), dtype=np.int32)
    vocabulary = vocabulary[vocabulary["term"] != PRESENT]
    spark.createDataFrame(vocabulary, "term string, index int").write.parquet(path % "terms")
    present = model.vocabulary.index(PRESENT)
    vector = F.unwrap_udt("vector")
    entries = model.transform(documents).select("source", F.inline(F.arrays_zip(vector.indices.alias("index"), vector["values"].alias("value"))))
    sums = entries.where(F.col("index") != present).groupBy("source", "index").agg(F.sum(F.col("value").cast("long")).alias("count"))
    sums.write.parquet(path % "counts")


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE (count + 1) / total), exact: in 128 bits where 64 don't hold the product."""
    wide = (count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    small = F.when(count < F.lit(LARGE), count)  # null otherwise, so that nothing overflows
    return F.coalesce(div((small + 1) * SCALE, total), div(wide, total.cast("decimal(19,0)"))) + 1


def value(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), q)


def common(block: pd.DataFrame) -> pd.DataFrame:
    """What the common terms of each two sources add, over the terms of one block."""
    block = block.sort_values("index", kind="stable")
    source, names = pd.factorize(block["source"])
    term, p, p0 = (block[c].to_numpy(np.int64) for c in ("index", "p", "p0"))
    starts, ends = np.searchsorted(term, term, "left"), np.searchsorted(term, term, "right")
    found = []
    for g in range(len(names)):
        own = np.flatnonzero(source == g)
        sizes = ends[own] - starts[own]
        mine = np.repeat(own, sizes)
        theirs = np.arange(len(mine)) + np.repeat(starts[own] - np.cumsum(sizes) + sizes, sizes)
        other = source[theirs] != g
        mine, theirs = mine[other], theirs[other]
        a, a0, b, b0 = p[mine], p0[mine], p[theirs], p0[theirs]
        more = (a - b) ** 2 // b - (a - b0) ** 2 // b0 - (a0 - b) ** 2 // b + (a0 - b0) ** 2 // b0
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, source[theirs], more)
        met = np.unique(source[theirs])
        found.append(pd.DataFrame({"source": names[g], "item": names[met], "value": sums[met]}))
    out = pd.concat(found)
    out.insert(0, "lang", block["lang"].iloc[0])
    return out


def pair_values(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """lang, source, item (another source) and value; counts with p, stats: lang, source, v, p0."""
    ship_package(counts.sparkSession)
    other = stats.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))

    def meet(left: DataFrame) -> DataFrame:
        return left.join(other, "lang").where(F.col("source") != F.col("item"))

    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    base = meet(stats).select("lang", "source", "item", (F.col("v") * value(p0, q0)).alias("value"))
    # terms of one of the two: how many there are of each count
    often = counts.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("n"))
    single = meet(often).select(
        "lang",
        F.inline(F.array(
            F.struct("source", "item", (F.col("n") * (value(p, q0) - value(p0, q0))).alias("value")),
            F.struct(F.col("item").alias("source"), F.col("source").alias("item"),
                     (F.col("n") * (value(q0, p) - value(q0, p0))).alias("value")),
        )),
    )
    blocks = counts.withColumn("block", F.expr(f"index div {BLOCK_TERMS}")).groupBy("lang", "slice", "block")
    both = blocks.applyInPandas(common, "lang string, source string, item string, value long")
    return base.unionByName(single).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(counts: DataFrame, terms: DataFrame, stats: DataFrame) -> DataFrame:
    """lang, source, item (a term more frequent in the source than in its language) and value."""
    sizes = stats.groupBy("lang").agg((F.sum("n") + F.max("v")).alias("total"))
    of_lang = counts.groupBy("lang", "slice", "index").agg(F.sum("count").alias("count")).join(sizes, "lang")
    of_lang = of_lang.select("lang", "slice", "index", share(F.col("count"), F.col("total")).alias("q")).join(terms, ["lang", "slice", "index"])
    found = counts.join(of_lang, ["lang", "slice", "index"]).where("p > q")
    return found.select("lang", "source", F.col("term").alias("item"), value(F.col("p"), F.col("q")).alias("value"))


def ranked(values: DataFrame, part: str, top: int | None = None) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    found = values.withColumn("rank", place)
    if top:
        found = found.where(F.col("rank") <= top)
    return found.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, slice_terms: int = SLICE_TERMS) -> DataFrame:
    """Per group (lang, source): every other source of the language, and the TOP_TERMS terms, by value."""
    counts, terms, groups = vectorized(docs, slice_terms)
    sums = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    n, v = (F.coalesce(c, F.lit(0).cast("long")) for c in ("n", "v"))
    stats = groups.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", n.alias("n"), v.alias("v"))
    total = F.greatest(F.col("n") + F.col("v"), F.lit(1))  # 0 only where V is 0 and nothing is summed
    stats = store(stats.withColumn("total", total).withColumn("p0", share(F.lit(0).cast("long"), total)), "stats")
    counts = store(
        counts.join(stats.select("lang", "source", "total", "p0"), ["lang", "source"])
        .withColumn("p", share(F.col("count"), F.col("total"))).drop("total"), "counts",
    )
    pairs = ranked(pair_values(counts, stats), "pair")
    return pairs.unionByName(ranked(term_values(counts, terms, stats), "term", TOP_TERMS))
