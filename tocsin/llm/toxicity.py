"""Toxicity: misspelled terms by Levenshtein automata over a lexicon trie, judged in their context.

The lexicon is learned from labelled documents: words of three letters or more, and openings of four or
more that a family of words shares, which stand in toxic documents and hardly in others. The labelled rows read are at most FIT_ROWS, the first by
a hash of their id, which is the classifier's documented bound; everything else covers all data.

All terms lie in one trie. The Levenshtein automaton of a word, run against the trie, is kept as states
(node, edits) that are made on demand and remembered by character, so that most words are dismissed
after two or three steps. A word matches a whole-word term within the edits its length allows, and an
opening term if one of its prefixes does. How many edits a term may differ by is set by what its
misspellings do on the labelled rows.

Each hit is weighed by a window of words around it. Quotation marks on both sides, words of reporting
or of mention speak for a quotation; address of a person speaks against. A logistic model over the
abusive and the quoted weight turns this into the score. A text without any hit scores lowest.

Defined results: null and empty texts have no hit; repeated rows are scored each; an empty table gives
an empty result; without labels of both kinds there are no terms, and every score is the prior's;
`clean` keeps the input's columns.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.near_dup import Shingler, mixed
from tocsin.llm.shared import id_and_text, kept_by, map_batches, slices, store

FIT_ROWS = 20_000  # labelled documents that the terms and the model are learned from, at most
THRESHOLD = 0.3
WINDOW = 6  # words on each side of a hit
LEAST_OPENING = 4  # letters; whole words have three at least
LONGEST_OPENING = 12
CERTAINTY = 16.0  # log-likelihood ratio that makes an opening a candidate
TERM_DOCUMENTS = 8  # different toxic documents that make a candidate a term
NEW_DOCUMENTS = 4  # or that it accounts for alone
SKETCHES = 3
COPY_SKETCHES = 16  # sketches by which near copies are told
KNOWN_WORDS = 400_000  # entries of a worker's memory of words

# fixed values: what marks a quotation, a mention, an address
QUOTES = "\"'‘’‚“”„«»"
MENTION = "said says wrote writes called calls calling quote quoted word words term terms phrase slur insult meaning".split()
ADDRESS = "you your youre are such u ur".split()


def edits_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class Lexicon:
    """Terms in a trie, and the automaton that finds them within some edits.

    `terms`: (letters, whole word or opening, most edits). A state is a set of (node, edits used, letters
    that may still be gone); states are numbered as they first occur, and moves are remembered.
    """

    def __init__(self, terms: list[tuple[str, bool, int]]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]  # terms that end at a node
        for number, (letters, _, _) in enumerate(terms):
            node = 0
            for letter in letters:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][letter]
            self.ends[node].append(number)
        self.reach = [0] * len(self.children)  # most edits of any term below a node
        for number, (letters, _, most) in enumerate(terms):
            node = 0
            self.reach[0] = max(self.reach[0], most)
            for letter in letters:
                node = self.children[node][letter]
                self.reach[node] = max(self.reach[node], most)
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.opened: list[tuple | None] = []  # best opening term that the state completes
        self.closed: list[tuple | None] = []  # best term if the word ends here
        self.number(self.grown({(0, 0)}))

    def grown(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With the nodes that leaving out letters of a term leads to."""
        todo, least = list(pairs), {}
        while todo:
            node, used = todo.pop()
            if used > self.reach[node] or least.get(node, 99) <= used:
                continue
            least[node] = used
            todo.extend((child, used + 1) for child in self.children[node].values())
        return frozenset(least.items())

    def number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            done = [(used, n) for node, used in state for n in self.ends[node] if used <= self.terms[n][2]]
            self.opened.append(min((x for x in done if not self.terms[x[1]][1]), default=None))
            self.closed.append(min(done, default=None))
        return self.numbers[state]

    def move(self, at: int, letter: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, used in self.states[at]:
            after.add((node, used + 1))  # a letter too many
            for own, child in self.children[node].items():
                after.add((child, used + (own != letter)))  # the letter, or another in its place
        self.moves[at][letter] = new = self.number(self.grown(after)) if self.terms else at
        return new

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, None if the word holds none."""
        at, best = 0, None
        for letter in word:
            new = self.moves[at].get(letter)
            at = self.move(at, letter) if new is None else new
            if not self.states[at]:
                return best
            if (o := self.opened[at]) is not None and (best is None or o < best):
                best = o
        c = self.closed[at]
        return c if best is None or (c is not None and c < best) else best


EDGES = re.compile(r"^\W+|\W+$")


def bare(word: str) -> str:
    return word if word.isalpha() else EDGES.sub("", word)


class Scanner:
    """Hits of a lexicon in texts, each with its window; words are looked up once per worker."""

    def __init__(self, terms: list[tuple[str, bool, int]]):
        self.lexicon = Lexicon(terms)
        self.known: dict[str, tuple[int, int] | None] = {}
        self.hit_words: set[str] = set()

    def learn(self, words: set[str]) -> None:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
            self.hit_words.clear()
        for word in words.difference(self.known):
            found = self.known[word] = self.lexicon.find(bare(word))
            if found is not None:
                self.hit_words.add(word)

    def hits(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """(edits, term, quotation 0 to 1) of each hit, and the number of words."""
        words = text.lower().split()
        distinct = set(words)
        self.learn(distinct)
        if self.hit_words.isdisjoint(distinct):
            return [], len(words)
        places = [i for i, w in enumerate(words) if w in self.hit_words]
        return [(*self.known[words[i]], quotation(words, i)) for i in places], len(words)


def quotation(words: list[str], at: int) -> float:
    """How much the window around a word speaks for a quotation or mention of it."""
    before, after = words[max(0, at - WINDOW) : at], words[at + 1 : at + 1 + WINDOW]
    opened = words[at][0] in QUOTES or any(w[0] in QUOTES for w in before)
    closed = words[at].rstrip(".,;:!?")[-1:] in tuple(QUOTES) or any(w.rstrip(".,;:!?")[-1:] in tuple(QUOTES) for w in after)
    near = {bare(w) for w in before + after}
    score = 0.6 * (opened and closed) + 0.3 * (not near.isdisjoint(MENTION)) - 0.3 * (not near.isdisjoint(ADDRESS))
    return min(1.0, max(0.0, score))


@dataclass(frozen=True)
class Model:
    terms: list[tuple[str, bool, int]] = field(default_factory=list)
    weights: tuple[float, ...] = (-4.0, 2.0, 0.0, 0.0, 0.0)


def features(hits: list[tuple[int, int, float]], words: int) -> list[float]:
    """Abusive weight, quoted weight, weight of misspelled hits, and hits per hundred words."""
    abuse = sum(1 - q for _, _, q in hits)
    quoted = sum(q for _, _, q in hits)
    misspelled = sum((1 - q) * (e > 0) for e, _, q in hits)
    return [math.log1p(abuse), math.log1p(quoted), math.log1p(misspelled), min(1.0, 100 * abuse / (words + 50) / 5)]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Stored (doc_id, text, toxic) of at most `rows` labelled documents outside the held-out part."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = id_and_text(docs)
    known_texts = texts.join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"])
    return store(known_texts.select("doc_id", "text", "toxic"), "labelled")


def copies_of(marks: np.ndarray) -> np.ndarray:
    """The group of near copies of each row of sketches: those of the first row that it is nearly the same as."""
    groups = np.full(len(marks), -1)
    first: dict[tuple, list[int]] = {}  # the first rows of the groups that have four sketches in common
    for row, mark in enumerate(marks):
        keys = [(at, *mark[at : at + 4].tolist()) for at in range(0, COPY_SKETCHES, 4)]
        near = np.array(sorted({r for key in keys for r in first.get(key, ())}), int)
        alike = near[(marks[near] == mark).sum(axis=1) >= 0.75 * COPY_SKETCHES]
        groups[row] = groups[alike[0]] if len(alike) else row
        if not len(alike):
            for key in keys:
                first.setdefault(key, []).append(row)
    return groups


def with_copies(rows: DataFrame) -> DataFrame:
    """The labelled rows with `copies`, the number of their group, and `part`, 1 / the rows of that group.

    Near copies of one label are a group, and so count as one document together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks = pa.array(sketches(batch.column("text").to_pylist(), COPY_SKETCHES).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), marks], ["doc_id", "toxic", "sketch"])

    found = map_batches(rows, run, "doc_id long, toxic int, sketch array<long>").collect()
    found.sort(key=lambda r: (r["toxic"], r["doc_id"]))
    groups: list[int] = []
    for toxic in (0, 1):
        marks = [r["sketch"] for r in found if r["toxic"] == toxic]
        groups += (len(groups) + copies_of(np.array(marks, np.int64).reshape(-1, COPY_SKETCHES))).tolist()
    size = Counter(groups)
    known = [(r["doc_id"], g, 1 / size[g]) for r, g in zip(found, groups, strict=True)]
    table = rows.sparkSession.createDataFrame(known, "doc_id long, copies long, part double")
    return rows.join(F.broadcast(table), "doc_id")


def plain_uses(words: list[str]) -> set[str]:
    """The words that stand at some place where nothing speaks for a quotation or mention."""
    marks = {w for w in set(words) if w[0] in QUOTES or w.rstrip(".,;:!?")[-1:] in tuple(QUOTES) or bare(w) in MENTION}
    near = {j for i, w in enumerate(words) if w in marks for j in range(max(0, i - WINDOW), min(len(words), i + WINDOW + 1))}
    plain = {w for i, w in enumerate(words) if i not in near}
    return plain.union(words[i] for i in near if words[i] not in plain and not quotation(words, i))


def openings(rows: DataFrame) -> dict[str, tuple[float, float]]:
    """Toxic and other documents that hold each telling opening of a word; a whole word ends in a blank.

    Near copies count as one document. An opening is telling by all its uses, or by those alone that
    aren't quoted or mentioned: how quoted uses count is left to the model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, ...] = Counter(), Counter(), Counter(), Counter()
        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("text", "toxic", "part")]
            for text, toxic, part in zip(*columns, strict=True):
                words = text.lower().split()
                plain = plain_uses(words)
                plainly = {p for w in set(map(bare, plain)) if len(w) > 2 for p in prefixes(w)}
                quoted = {p for w in set(map(bare, set(words) - plain)) if len(w) > 2 for p in prefixes(w)}
                for count, held in ((counts[toxic], quoted - plainly), (counts[2 + toxic], plainly)):
                    if part == 1:
                        count.update(held)
                    else:
                        for p in held:
                            count[p] += part
        names = list(set().union(*counts))
        values = [[c[n] for n in names] for c in counts]
        every = [[a + b for a, b in zip(values[k], values[2 + k], strict=True)] for k in (0, 1)]
        columns = [pa.array(names, pa.string()), *(pa.array(v, pa.float64()) for v in every + values[2:])]
        yield pa.RecordBatch.from_arrays(columns, ["opening", *kinds])

    kinds = ["other", "toxic", "other_plain", "toxic_plain"]
    counted = map_batches(rows, run, "opening string, " + ", ".join(f"{k} double" for k in kinds)).groupBy("opening")
    counted = counted.agg(*[F.round(F.sum(k), 6).alias(k) for k in kinds])  # parts of a group add up to 1
    # by chance alone, none of a million openings stands this much more in toxic documents than others do
    base = rows.agg((F.sum(F.col("toxic") * F.col("part")) / F.sum("part")).alias("share")).first()["share"] or 0.0
    base = min(max(base, 1e-6), 1 - 1e-6)

    def tells(toxic: Column, other: Column) -> Column:
        held, q = toxic + other, toxic / (toxic + other)
        rest = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - base))).otherwise(0.0)
        return (toxic >= 4) & (toxic >= 20 * other) & (held * (q * F.log(q / base) + rest) >= CERTAINTY)

    plainly = tells(F.col("toxic_plain"), F.col("other_plain"))
    telling = counted.where(tells(F.col("toxic"), F.col("other")) | plainly)
    return {r["opening"]: (r["toxic"], r["other"]) for r in telling.collect()}


def prefixes(word: str) -> list[str]:
    return [word[:n] for n in range(3, min(len(word), LONGEST_OPENING) + 1)] + [word + " "]


def terms_of(found: dict[str, tuple[float, float]]) -> list[tuple[str, bool]]:
    """Telling openings, each made longer as long as nearly all its documents agree.

    An opening is left out only if a term that is kept covers it. One that is made longer, or is too short
    for a term, gives way to the telling openings below it.
    """
    below: dict[str, list[str]] = {}  # the nearest telling openings below each; "" for those below none
    for o in found:
        above = next((o[:n] for n in range(len(o) - 1, 2, -1) if o[:n] in found), "")
        below.setdefault(above, []).append(o)
    out, todo = [], below.get("", [])[:]
    while todo:
        o = todo.pop()
        more = below.get(o, [])
        longer = any(found[c][0] >= 0.9 * found[o][0] for c in more)
        if longer or (o[-1] != " " and len(o) < LEAST_OPENING):
            todo.extend(more)
        else:
            out.append(o)
    return [(o.rstrip(" "), o[-1] == " ") for o in sorted(out, key=lambda o: (-found[o][0], o))]


class Scanned(NamedTuple):
    toxic: int
    words: int
    hits: list[tuple[int, int, float]]
    sketch: list[int]
    copies: int


def sketches(texts: list[str], number: int = SKETCHES) -> np.ndarray:
    """Least hashes of each text's shingles, which near copies mostly share; 0 without words."""
    out = np.zeros((len(texts), number), np.uint64)
    doc, ids, _ = Shingler().shingles(texts)
    filled, starts = np.unique(doc, return_index=True)
    for k in range(number if len(starts) else 0):
        out[filled, k] = np.minimum.reduceat(mixed(ids + np.uint64((k + 1) << 48)), starts)
    return out.view(np.int64)


def scan_rows(rows: DataFrame, terms: list[tuple[str, bool, int]]) -> list[Scanned]:
    """What the terms find in each labelled row. At most FIT_ROWS short rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(terms)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            found = [scanner.hits(t) for t in texts]
            lists = [[[x[k] for x in h] for h, _ in found] for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("toxic"),
                    pa.array([w for _, w in found], pa.int64()),
                    pa.array(lists[0], pa.list_(pa.int32())),
                    pa.array(lists[1], pa.list_(pa.int32())),
                    pa.array(lists[2], pa.list_(pa.float64())),
                    pa.array(sketches(texts).tolist(), pa.list_(pa.int64())),
                    batch.column("copies"),
                ],
                ["toxic", "words", "edits", "terms", "quotation", "sketch", "copies"],
            )

    schema = "toxic int, words long, edits array<int>, terms array<int>, quotation array<double>, sketch array<long>, copies long"
    return [
        Scanned(r["toxic"], r["words"], list(zip(r["edits"], r["terms"], r["quotation"], strict=True)), r["sketch"], r["copies"])
        for r in map_batches(rows, run, schema).collect()
    ]


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    sample = with_copies(labelled(docs, labels, rows))
    terms = [(w, whole, edits_allowed(len(w))) for w, whole in terms_of(openings(sample))]
    scanned = scan_rows(sample, terms)
    return model_of(terms, scanned)


def needed(terms: list[tuple[str, bool, int]], scanned: list) -> set[int]:
    """Terms that enough toxic documents hold, or that account for some which no other term does.

    Near copies of a document count as one: they agree in nearly all of its sketches.
    """

    def different(rows: set[int]) -> int:
        return min((len({scanned[d].sketch[k] for d in rows}) for k in range(SKETCHES)), default=0)

    held: dict[int, set[int]] = {}
    for d, row in enumerate(scanned):
        for edits, n, _ in row.hits:
            if row.toxic and not edits:
                held.setdefault(n, set()).add(d)
    kept, covered = set(), set()
    for n in sorted(held, key=lambda n: (-len(held[n]), terms[n])):
        if different(held[n]) >= TERM_DOCUMENTS or different(held[n] - covered) >= NEW_DOCUMENTS:
            kept.add(n)
            covered |= held[n]
    return kept


def model_of(terms: list[tuple[str, bool, int]], scanned: list) -> Model:
    """The needed terms, how many edits each may differ by, and the weights, from the labelled rows' hits.

    Misspellings of a term count as far as they hardly ever stand, outside of quotations, in documents
    that aren't toxic. Near copies count as one document there.
    """
    chosen = needed(terms, scanned)
    wrong: dict[tuple[int, int], set[int]] = {}  # other documents in which a term stands with so many edits
    for row in scanned:
        for edits, n, quoted in row.hits:
            if edits and not row.toxic and not quoted:
                wrong.setdefault((n, edits), set()).add(row.copies)
    others = len({row.copies for row in scanned if not row.toxic})
    fine: dict[int, int] = {}
    for n in chosen:
        held: set[int] = set()
        fine[n] = 0
        for edits in range(1, terms[n][2] + 1):
            held |= wrong.get((n, edits), set())
            if len(held) <= others / 5000:
                fine[n] = edits
    x = [features([h for h in row.hits if h[0] <= fine.get(h[1], -1)], row.words) for row in scanned]
    y = [row.toxic for row in scanned]
    kept = [(terms[n][0], terms[n][1], fine[n]) for n in sorted(chosen)]
    return Model(kept, logistic(np.array(x).reshape(-1, 4), np.array(y, float)))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps, held to a prior: no hit, not toxic; one hit, likely toxic."""
    x = np.hstack([np.ones((len(x), 1)), x])
    prior = np.array(Model().weights)
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def score_of(model: Model, hits: list[tuple[int, int, float]], words: int) -> float:
    z = model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], features(hits, words), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def scanner_for(model: Model) -> Scanner:
    """The worker's scanner of these terms, kept with its memory of words between tasks."""
    key, scanners = hash(tuple(model.terms)), kept_by("scanners")
    if key not in scanners:
        scanners.clear()
        scanners[key] = (model.terms, Scanner(model.terms))
    return scanners[key][1]


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, exact and misspelled hits of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_for(model)
        for batch in slices(batches):
            found = [scanner.hits(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([score_of(model, *f) for f in found], pa.float64()),
                    pa.array([sum(e == 0 for e, _, _ in h) for h, _ in found], pa.int64()),
                    pa.array([sum(e > 0 for e, _, _ in h) for h, _ in found], pa.int64()),
                ],
                ["doc_id", "score", "exact_hits", "misspelled_hits"],
            )

    schema = "doc_id long, score double, exact_hits long, misspelled_hits long"
    return map_batches(id_and_text(docs), run, schema)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (and hits) of every document, by a model of the other labels."""
    return scores(docs, fit(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "exact_hits",
        "misspelled_hits",
    )


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with the columns they came with."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_for(model)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            kept = [score_of(model, *scanner.hits(t or "")) < threshold for t in texts]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return map_batches(docs, run, docs.schema)
