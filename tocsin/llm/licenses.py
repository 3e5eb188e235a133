"""License scans with a positional index of rare words, in SQL expressions only.

A template is a text with key phrases. The index is data: words, each with the templates and positions it
stands at (postings), in a hash table that travels as one constant. Document frequencies of the key words
over the whole corpus (as many numbers as there are such words) choose the postings: the words with the
highest IDF of each template's first key phrase. A file without any of these words is done. In the
others, each place of such a word looks up its postings and proposes templates at relative starts
(position in the file less position in the template); a start that all postings of a template agree on
is a candidate. There the first key phrase is verified word by word, and the others must stand whole at
most `SLACK` words from their places, which leaves room for names and edits. `share` is the share of the
template's words that stand where one of the key phrases puts them.

Defined results: a null text has no words and no labels; repeated rows are scanned each; an empty table
gives an empty result; other columns are ignored. A text that holds the terms of several templates has
all their labels. Templates may be of any number: neither expressions nor plans grow with the list.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.license_texts import FULL_TEXTS
from tocsin.llm.shared import id_and_text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split_words(text: str) -> list[str]:
    """Words of a template, as `words` finds them in files."""
    return WORD.findall(text.lower())


@dataclass(frozen=True)
class Template:
    """All `keys` (the whole text if there are none) stand in `text` and must be found whole."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return split_words(self.text)

    @property
    def key_words(self) -> list[list[str]]:
        return [split_words(k) for k in self.keys or (self.text,)]

    @property
    def keys_at(self) -> list[int]:
        words = self.words
        return [next(i for i in range(len(words)) if words[i : i + len(k)] == k) for k in self.key_words]


# fixed values: the base phrases, then openings of public licence texts; whole texts follow them
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        ("permission is hereby granted free of charge to any person obtaining a copy",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        ("redistribution and use in source and binary forms",),
    ),
    Template("gpl", "under the terms of the gnu general public license", ("gnu general public license",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("mpl-2", "subject to the terms of the mozilla public license", ("mozilla public license",)),
    Template("cc-by", "licensed under a creative commons attribution", ("creative commons attribution",)),
    Template("cc-by-sa", "cc by sa"),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software",),
    ),
    *[Template(label, text, keys) for label, text, keys in FULL_TEXTS],
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HIT = "struct<label:string,base:boolean,start:long,share:double>"
POSTINGS = 3  # of each template, on the words with the highest IDF
SLACK = 32  # words by which a later key phrase may stand off its place
SHIFTS = [0, *[s for d in range(1, SLACK + 1) for s in (-d, d)]]  # nearest first


def words(text: Column) -> Column:
    """Words of the lower-cased text. (`lower` also changes other capitals, into word characters as well.)"""
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def once(value: Column, use) -> Column:
    """`use(value)` with `value` worked out once, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@dataclass(frozen=True)
class Posting:
    word: str
    template: int
    at: int


def postings(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> list[Posting]:
    """The index: the words with the highest IDF of each first key phrase, with their places in the template.

    The highest IDF is the lowest document frequency; at a tie the longer word.
    """
    vocabulary = sorted({w for t in templates for w in t.key_words[0]})
    found = F.array_intersect(words(F.col("text")), word_list(vocabulary))
    counted = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    frequency = {r["word"]: r["n"] for r in counted}
    out = []
    for number, t in enumerate(templates):
        key, at = t.key_words[0], t.keys_at[0]
        rarest = sorted(range(len(key)), key=lambda i: (frequency.get(key[i], 0), -len(key[i]), i))
        out += [Posting(key[i], number, at + i) for i in rarest[:POSTINGS]]
    return out


def word_list(found: list[str]) -> Column:
    return F.split(F.lit(" ".join(found)), " ")


def hash_table(index: list[Posting]) -> Column:
    """Postings by crc32 of their word: a constant, so a lookup opens one slot however large the index is."""
    slots: list[list[dict]] = [[] for _ in index]
    for p in index:
        slots[zlib.crc32(p.word.encode()) % len(slots)].append({"word": p.word, "t": p.template, "at": p.at})
    return constant(slots, "array<array<struct<word:string,t:int,at:int>>>")


def constant(value, schema: str) -> Column:
    """A nested constant. Its JSON is read once, when the plan is optimized, not for each row."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def template_table(templates: tuple[Template, ...], index: list[Posting]) -> Column:
    """Templates by number, as a constant: label, words, key phrases and the votes a candidate needs."""
    votes = [0] * len(templates)
    for p in index:
        votes[p.template] += 1

    rows = [
        {
            "label": t.label,
            "base": t.base,
            "words": t.words,
            "keys": [{"words": k, "at": at} for k, at in zip(t.key_words, t.keys_at, strict=True)],
            "votes": needed,
        }
        for t, needed in zip(templates, votes, strict=True)
    ]
    key = "struct<words:array<string>,at:int>"
    return constant(rows, f"array<struct<label:string,base:boolean,words:array<string>,keys:array<{key}>,votes:int>>")


def candidates(found: Column, index: list[Posting], table: Column) -> Column:
    """(t, start) of each template and relative start that all the template's postings agree on."""
    slots = hash_table(index)
    rare = sorted({p.word for p in index})
    listed = F.filter(F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(rare))

    def proposed(x: Column) -> Column:
        slot = F.get(slots, F.pmod(F.crc32(x["w"].cast("binary")), F.lit(len(index))).cast("int"))
        own = F.filter(slot, lambda p: p["word"] == x["w"])
        return F.transform(own, lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["at"]).alias("start")))

    def agreed(s: Column) -> Column:
        # equal proposals are neighbours: a run begins where one differs from the one before
        numbered = F.transform(s, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
        begins = F.filter(numbered, lambda x: ~F.get(s, x["i"] - 1).eqNullSafe(x["p"]))

        def counted(b: Column) -> Column:
            def run(x: Column, j: Column) -> Column:
                votes = F.coalesce(F.get(b, j + 1)["i"], F.size(s)) - x["i"]
                return F.struct(x["p"]["t"].alias("t"), x["p"]["start"].alias("start"), votes.alias("votes"))

            return F.transform(b, run)

        return F.filter(once(begins, counted), lambda c: c["votes"] == F.get(table, c["t"])["votes"])

    return once(F.sort_array(F.flatten(F.transform(listed, proposed))), agreed)


def hits(found: Column, templates: tuple[Template, ...], index: list[Posting]) -> Column:
    """Verified places of templates in a file, `found` being its words."""
    table = template_table(templates, index)
    lead, near = F.array(F.lit(0)), constant(SHIFTS, "array<int>")

    def stands(words_: Column, at: Column) -> Column:
        return (at >= 0) & (F.slice(found, F.greatest(at, F.lit(0)) + 1, F.size(words_)) == words_)

    def placed(c: Column) -> Column:
        """The candidate with each key phrase's shift, null where the phrase is missing."""

        def shift(key: Column, number: Column) -> Column:
            allowed = F.when(number == 0, lead).otherwise(near)
            return F.get(F.filter(allowed, lambda s: stands(key["words"], c["start"] + key["at"] + s)), F.lit(0))

        shifts = F.transform(F.get(table, c["t"])["keys"], shift)
        return F.struct(c["t"].alias("t"), c["start"].alias("start"), F.array_distinct(shifts).alias("shifts"))

    def hit(p: Column) -> Column:
        def of(t: Column) -> Column:
            def in_place(x: Column) -> Column:
                return F.exists(p["shifts"], lambda s: F.coalesce(F.get(found, p["start"] + s + x["j"]) == x["w"], F.lit(False)))

            numbered = F.transform(t["words"], lambda w, j: F.struct(w.alias("w"), j.alias("j")))
            share = F.size(F.filter(numbered, in_place)) / F.size(t["words"])
            return F.struct(
                t["label"].alias("label"), t["base"].alias("base"), p["start"].cast("long").alias("start"), share.alias("share")
            )

        return once(F.get(table, p["t"]), of)

    def verified(c: Column) -> Column:
        return F.transform(F.filter(F.transform(c, placed), lambda p: ~F.exists(p["shifts"], lambda s: s.isNull())), hit)

    none = F.array().cast(f"array<{HIT}>")
    any_rare = F.arrays_overlap(found, word_list(sorted({p.word for p in index})))
    return F.when(any_rare, once(candidates(found, index, table), verified).cast(f"array<{HIT}>")).otherwise(none)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words and hits (label, base, start, share) of every document."""
    texts = id_and_text(docs)
    index = postings(texts, templates)

    def one(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), hits(w, templates, index).alias("hits"))

    return texts.select("doc_id", once(words(F.col("text")), one).alias("x")).select("doc_id", "x.n_words", "x.hits")


def digest(scanned: DataFrame) -> DataFrame:
    """Places and labels of the base phrases, labels of all templates, and the best share of words in place."""

    def listed(found: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda h: h["label"]))), ",")

    base = F.filter("hits", lambda h: h["base"])
    starts = F.transform(base, lambda h: h["start"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0)).alias("score"),
    )
