"""Quality rules as a short-circuit cascade, in SQL expressions only.

Each rule is a condition on a text. On a sample of about SAMPLE_ROWS texts the cascade measures what a rule
costs (time of a pass that evaluates only that rule, on the expressions that are used later, beyond that of a pass
without any) and how often it rejects; rules are then tried in the order of rejections per cost, and a text that
one rule rejects isn't shown to the next (CASE stops at the first that holds). The sample decides the order alone:
which texts are kept is the same in any order. Where the counts are asked for anyway (`measured`), they are worked
out for every text, and the order is that of the rules beyond the base ones over ready counts.

Words are `[^\\x20\\x09-\\x0D]+`. Defined results: a null text has no words and fails; repeated rows are
judged each; an empty table gives an empty result; in `passed` all columns of the input stay as they
are, whatever their names, in `measured` only doc_id is read beside the text.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.shared import store

SAMPLE_ROWS = 1000  # texts on which costs and rejections are estimated, about
SAMPLE_PARTS = 8  # files that the sample is stored in
RUNS = 2  # passes over the sample for each rule, of which the faster counts
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
INDEX_BITS = 20  # a text with fewer words than this has bits is sorted as plain numbers


def once(value: Column, use) -> Column:
    """`use(value)` with `value` worked out once, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def lines(text: Column) -> Column:
    """Lines that hold a word: how many there are, and how many equal an earlier one."""
    held = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counted(x: Column) -> Column:
        n = F.size(x).cast("long")
        return F.struct(n.alias("n"), (n - F.size(F.array_distinct(x))).alias("equal"))

    return once(held, counted)


def n_repeat_words(found: Column) -> Column:
    """Words that lie in a window of three words which the text holds twice or more; `found`: its words.

    Windows are known by a 64-bit hash. Where any two are equal, they are sorted with their places, and
    neighbours of equal hash are the repeated ones. Their places, sorted again, each add the words up to
    the next one's place, three at most.
    """

    def windows(w: Column) -> Column:
        hashes = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.slice(hashes, F.lit(1), F.size(w) - 2)

    def among_equals(sorted_places: Column, h: Column, place) -> Column:
        """Places of windows whose neighbour in the order has the same hash."""
        same = lambda x, j: F.coalesce(F.get(h, place(F.get(sorted_places, j))) == F.get(h, place(x)), F.lit(False))
        twice = F.filter(sorted_places, lambda x, i: same(x, i + 1) | same(x, i - 1))
        return F.sort_array(F.transform(twice, place))

    def repeated(h: Column) -> Column:
        mask = F.lit((1 << INDEX_BITS) - 1).cast("long")
        packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, INDEX_BITS).bitwiseOR(i.cast("long"))))
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        short = once(packed, lambda s: among_equals(s, h, lambda x: x.bitwiseAND(mask).cast("int")))
        long = once(pairs, lambda s: among_equals(s, h, lambda x: x["i"]))
        return F.when(F.size(h) < 1 << INDEX_BITS, short).otherwise(long)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    none = F.lit(0).cast("long")

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(once(repeated(h), covered))

    return F.when(F.size(found) < 4, none).otherwise(once(windows(found), count))


def facts(text: Column) -> dict[str, Column]:
    """What the rules ask of a text, each an expression of its own."""
    found = lambda use: once(words(text), use)
    return {
        "n_words": F.size(words(text)).cast("long"),
        "word_chars": F.length(without(text, SPACES)).cast("long"),
        "n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"),
        "lines": lines(text),
        "n_capitals": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long"),
        "repeats": found(lambda w: F.struct(F.size(w).cast("long").alias("n"), n_repeat_words(w).alias("repeated"))),
    }


@dataclass(frozen=True)
class Limits:
    """The rules' thresholds; the base rules' are the first two."""

    least_words: int = 50
    repeat_percent: int = 50
    symbols_per_char: float = 0.03
    dup_line_share: float = 0.5
    mean_word_length: tuple[float, float] = (2.0, 20.0)
    capital_share: float = 0.5


BASE_RULES = ("few_words", "repetitive")


def rules(f: dict[str, Column], limits: Limits = Limits()) -> dict[str, Column]:
    """What each rule rejects. Texts without words fall under the first."""
    low, high = limits.mean_word_length
    return {
        "few_words": f["n_words"] < limits.least_words,
        "repetitive": once(f["repeats"], lambda r: r["repeated"] * 100 > r["n"] * limits.repeat_percent),
        "symbols": f["n_symbols"] > f["word_chars"] * limits.symbols_per_char,
        "repeated_lines": once(f["lines"], lambda x: x["equal"] > x["n"] * limits.dup_line_share),
        "word_length": ~once(f["n_words"], lambda n: f["word_chars"].between(n * low, n * high)),
        "capitals": f["n_capitals"] > f["word_chars"] * limits.capital_share,
    }


def sample_of(docs: DataFrame, text: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The column `text` of about `rows` rows taken at random, stored; each partition sends its share of them."""
    share = min(1.0, rows / max(docs.count(), 1))
    some = docs.select(text.alias("text")).sample(share, seed=7)
    return store(some.repartition(SAMPLE_PARTS), "rule-sample")


def rejections_per_cost(sample: DataFrame, by_name: dict[str, Column]) -> list[str]:
    """Rule names, the most rejections per second first, as measured on the stored rows of `sample`."""

    def spent(rule: Column) -> tuple[float, float]:
        times, share = [], 0.0
        for _ in range(RUNS):
            began = time.perf_counter()
            seen = sample.agg(F.count("text").alias("n"), F.count_if(rule).alias("rejected")).first()
            times.append(time.perf_counter() - began)
            share = seen["rejected"] / max(seen["n"], 1)
        return min(times), share

    idle, _ = spent(F.length("text") < 0)
    costs = {name: spent(rule) for name, rule in by_name.items()}
    return sorted(costs, key=lambda n: -costs[n][1] / max(costs[n][0] - idle, 1e-3))


def first_rejection(
    f: dict[str, Column], order: list[str], limits: Limits = Limits(), but: tuple[str, ...] = ()
) -> Column:
    """Name of the first rule, in this order, that rejects the text; null if none does."""
    by_name = rules(f, limits)
    case = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in (n for n in order if n not in but):
        case = case.when(by_name[name], F.lit(name))
    return case


def passed(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that no rule rejects, with the columns they came with."""
    text = F.coalesce(docs["text"], F.lit(""))
    order = rejections_per_cost(sample_of(docs, text), rules(facts(F.col("text")), limits))
    return docs.where(first_rejection(facts(text), order, limits).isNull())


def measured(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per document the base counts, the base verdict and the cascade's.

    The counts are asked for anyway, so the rules read them; the base rules decide first.
    """
    texts = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    f = facts(F.col("text"))
    taken = ("word_chars", "n_symbols", "lines", "repeats")
    counts = [f[n].alias(n) for n in taken]
    counted = texts.select("doc_id", "text", *counts)
    known = {n: F.col(n) for n in taken} | {"n_words": F.col("repeats.n"), "n_capitals": f["n_capitals"]}
    by_name = rules(known, limits)
    beyond = {name: rule for name, rule in by_name.items() if name not in BASE_RULES}
    sample = store(sample_of(texts, F.col("text")).select("text", *counts), "rule-sample")
    order = rejections_per_cost(sample, beyond)
    return (
        counted.withColumn("base_failed", by_name["few_words"] | by_name["repetitive"])
        .withColumn("kept", ~F.col("base_failed") & first_rejection(known, order, limits, BASE_RULES).isNull())
        .select(
            "doc_id",
            F.col("repeats.n").alias("n_words"),
            "word_chars",
            "n_symbols",
            F.col("lines.equal").alias("n_dup_lines"),
            F.col("repeats.repeated").alias("n_repeat_words"),
            "base_failed",
            "kept",
        )
    )
