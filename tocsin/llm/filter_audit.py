"""Filter interaction audit: what each filter removes, in every order in which the filters can be applied.

Each document gets a mask with one bit per filter that it fails. The masks are counted per part (lang) into
mask cells, at most 2 to the number of filters each, and the orders are enumerated on the cells alone, by a
recursive CTE: a prefix of filters is extended with each unused letter, joined with its part's cells, and carries
the bits applied so far. Each level of the recursion emits the metrics of its step, so orders with a common prefix
share the work. At the end every full order is joined with its own prefixes.

The filter for repeated texts needs the whole table. It isn't a join: documents are counted per (SHA-256 of the
text, part, mask, labels) with their least doc_id and the rows that hold it, and a document repeats an earlier one
unless it is among the rows with the least doc_id of its text. A text that a third of all rows share is summed up
before it is shuffled.

Defined results: null text is an empty text, null lang the part ''. Words are runs without ASCII white space,
compared as they stand. Repeated rows count each; rows with the same text and the same doc_id are no repeats of
each other. A row without doc_id repeats nothing and is repeated by nothing; it has no labels. A doc_id with several
labels has a label if any of its rows says so. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.shared import store

LETTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT = 80  # percent of the words
MOST_CAPITALS = 10  # percent of the characters
SYMBOLS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = "\t\n\x0b\x0c\r"
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
NO_LABELS_SPREAD = 1_000  # rows without doc_id are dealt over so many keys of the join with labels


def bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def text_mask(text: Column) -> Column:
    """The bits of the filters that look at one text only."""
    words = F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    fails = {
        "A": n_words < LEAST_WORDS,
        "B": 100 * n_distinct.cast("long") < LEAST_DISTINCT * n_words.cast("long"),
        "C": 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }
    mask = F.lit(0)
    for letter, failed in fails.items():
        mask = mask + F.when(failed, bit(letter)).otherwise(0)
    return mask


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents counted by part, node (hash of the text), mask of the text's own filters and labels.

    `n` rows, `low`: their least doc_id, `n_low`: rows that have it or have no doc_id.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.sha2(text, 256).alias("node"),
        text_mask(text).alias("mask"),
    )
    # equal rows first, so that a repeated doc_id weighs no more than one row in the join
    rows = rows.groupBy("doc_id", "part", "node", "mask").agg(F.count(F.lit(1)).alias("n"))
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("node"), F.lit(NO_LABELS_SPREAD))).otherwise(F.lit(0))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    labelled = rows.withColumn("spread", spread).join(known.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)
    return labelled.groupBy(
        "node", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    ).agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("low"),
        F.min_by(own, F.col("doc_id")).alias("n_low"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_without"),
    )


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents fail exactly the filters of the mask."""
    least = F.min("low").over(Window.partitionBy("node"))  # a text has a row per part and labels here, not per document
    counted = masked(docs, labels).withColumn("least", least)
    first = F.coalesce(F.when(F.col("low") == F.col("least"), F.col("n_low")), F.lit(0)) + F.col("n_without")
    split = counted.select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("mask").alias("mask"), first.alias("n")),
            F.struct((F.col("mask") + bit("E")).alias("mask"), (F.col("n") - first).alias("n")),
        )).alias("c"),
    )
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("c.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("c.n")).otherwise(0)).alias("toxic"),
    )


def _total(field: str, condition: str) -> str:
    """Sum of a field over the cells c of a part that meet a condition; p: the prefix so far, l: the new letter."""
    return f"aggregate(filter(cells, c -> {condition}), 0L, (s, c) -> s + c.{field})"


REMOVED = "(c.mask & applied) = 0 AND (c.mask & bit) <> 0"
METRICS = ", ".join(
    f"{_total(field, condition)} AS {name}"
    for name, field, condition in (
        ("kept", "n", "(c.mask & (applied | bit)) = 0"),
        ("removed", "n", REMOVED),
        ("redundant", "n", "(c.mask & applied) <> 0 AND (c.mask & bit) <> 0"),
        ("unique_fails", "n", "c.mask = bit"),
        ("good_lost", "good", REMOVED),
        ("toxic_lost", "toxic", REMOVED),
    )
)
NOTHING = ", ".join(f"0L AS {name}" for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))

# {cells}: one row per part with the array of its cells. A prefix never meets another part's cells.
PREFIXES = f"""
WITH RECURSIVE prefixes AS (
  SELECT part, '' AS prefix, 0 AS applied, 0 AS step, {NOTHING} FROM {{cells}}
  UNION ALL
  SELECT part, prefix || letter AS prefix, applied | bit AS applied, step + 1 AS step, {METRICS}
  FROM (
    SELECT p.part, p.prefix, p.applied, p.step, p.cells, l.letter, l.bit FROM (
      SELECT q.part, q.prefix, q.applied, q.step, m.cells FROM prefixes q JOIN {{cells}} m ON q.part = m.part
      WHERE q.step < {len(LETTERS)}) p
    LATERAL VIEW inline(filter(array({", ".join(f"named_struct('letter', '{x}', 'bit', {bit(x)})" for x in LETTERS)}),
      x -> (p.applied & x.bit) = 0)) l AS letter, bit)
)
SELECT * FROM prefixes WHERE step > 0"""


def prefixes(counted: DataFrame) -> DataFrame:
    """The metrics of the last step of every order's every prefix, per part; `counted` as from `cells`."""
    spark = counted.sparkSession
    by_part = store(
        counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "mask-cells"
    )  # a part has at most 32 cells
    return spark.sql(PREFIXES.format(cells="{mask_cells}"), mask_cells=by_part)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with that step's metrics and its filter's Shapley total."""
    counted = store(cells(docs, labels), "cells")
    spark = docs.sparkSession
    limit = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, -1)  # 325 rows a part are no endless recursion, however many parts there are
    try:
        steps = store(prefixes(counted), "prefixes")
    finally:
        spark.conf.set(ROW_LIMIT, limit)
    letter = F.substring("prefix", -1, 1)
    full = F.factorial(F.lit(len(LETTERS)) - F.col("step"))  # so many orders begin with the prefix
    shapley = steps.groupBy("part", letter.alias("letter")).agg(F.sum(F.col("removed") * full).alias("shapley"))
    orders = steps.where(F.col("step") == len(LETTERS)).select("part", F.col("prefix").alias("filter_order"))
    places = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    places = places.withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    found = places.join(steps.drop("step", "applied"), ["part", "prefix"]).withColumn("letter", letter)
    return found.join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
