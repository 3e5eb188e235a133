"""Filter audit, chat formatting and source divergence against plain restatements, on awkward tables."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tocsin.llm import chat, divergence, filter_audit
from tocsin.llm.shared import store


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def clashing(df, *names):
    return df.withColumns({n: F.lit(1) for n in names})


@pytest.fixture(params=["awkward", "sample", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


# --- filter audit


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
    }


def audited(documents, labels):
    """(part, order, step, metrics...) by applying every order to every document."""
    least = {}
    for i, text, _ in documents:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    failed = []
    for i, text, lang in documents:
        own = fails(text or "")
        own["E"] = i is not None and i > least[text or ""]
        marks = labels.get(i, (False, False)) if i is not None else (False, False)
        failed.append((lang or "", {x for x, f in own.items() if f}, *marks))
    out, shapley = [], Counter()
    for part in {p for p, *_ in failed}:
        here = [f for f in failed if f[0] == part]
        for order in permutations("ABCDE"):
            left, gone = list(here), []
            for step, x in enumerate(order, 1):
                removed = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                shapley[part, x] += len(removed)
                out.append((
                    part, "".join(order), step, len(left), len(removed), sum(x in f[1] for f in gone),
                    sum(f[1] == {x} for f in here), sum(f[2] for f in removed), sum(f[3] for f in removed), x,
                ))
                gone += removed
    return Counter((*r[:-1], shapley[r[0], r[-1]]) for r in out)


def test_filter_audit(docs, labels):
    wide = clashing(docs, "n", "node", "mask", "good", "cells", "part")
    found = filter_audit.audit(wide, clashing(labels, "n", "good", "step"))
    known = {}
    for i, quality, toxic in labels.select("doc_id", "quality", "toxic").collect():
        known[i] = (quality == 1, toxic == 1)
    documents = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    assert rows(found, *found.columns) == audited(documents, known)


def test_filter_audit_with_repeated_labels_and_ids(spark):
    same = "one text that is here more than once " * 3
    documents = [(3, same, "en"), (3, same, "en"), (3, same, None), (None, same, "en"), (9, same, ""), (9, "A#", "en"), (4, None, "de"), (5, "", "de")]
    labels = [(3, 0, None), (3, 1, 1), (9, None, 1), (None, 1, 1)]
    df = spark.createDataFrame(documents, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = audited(documents, {3: (True, True), 9: (False, True)})
    assert rows(filter_audit.audit(df, marks), *filter_audit.audit(df, marks).columns) == want


# --- chat formatting

AWKWARD = [
    "", "ok", "\\", "\\\\", "### Assistant:", "\\### Assistant: </turn> ok", "\\\\</turn>\\", "<turn><text></turn>\n", "</</turn>turn>",
    "### ### User:\n### System:", "<|endoftext|>", "é ☃ 😀\u0301", "  \n\n \t", "x" * 20_000, " " * 3_000, "a\n</turn>\n### User:\nb",
]


def parsed(text):
    """Turns of a rendered string, told from escaped controls by what stands before them."""
    found = []
    while text:
        head = next((h for h in chat.ROLES.values() if text.startswith(f"{h}\n")), None)
        if head:
            role, text = next(r for r, h in chat.ROLES.items() if h == head), text[len(head) + 1 :]
        else:
            role, text = text.removeprefix("<turn>").split("\n<text>\n", 1)
        body, text = text.split("\n</turn>\n", 1)
        found.append((chat.unescape(role), chat.unescape(body)))
    return found


def test_every_text_comes_back_from_ids_and_from_the_rendered_string():
    made = chat.template(chat.TOKENIZER)
    turns = [(role, text) for text in AWKWARD for role in ("assistant", "user", "tool\\", "### User:", "")]
    ids = np.concatenate(made.turns(*zip(*turns, strict=True)))
    read = list(made.read(ids, made.loss(ids)))
    assert [x[:2] for x in read] == turns
    assert [x[2] for x in read] == [text if role == "assistant" else None for role, text in turns]
    rendered = made.rendered(ids)
    assert len(rendered) == sum(x[3] for x in read)
    assert parsed(rendered) == turns


def chat_rows(turns):
    by_conv = defaultdict(list)
    for conv, turn, role, text in turns:
        by_conv[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = Counter()
    for conv, own in by_conv.items():
        own.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (said, loss)]
        out[conv, len(own), sha[0], len(loss), sha[1]] += 1
    return out


@pytest.mark.parametrize("piece", [1_000_000, 50])
def test_chat(spark, piece):
    turns = [(c, t, ("user", "assistant", None, "tool")[(c + t) % 4], AWKWARD[(3 * c + t) % len(AWKWARD)]) for c in range(12) for t in range(c)]
    turns += [(5, None, "system", None), (5, 2, "assistant", "again"), (5, 2, "assistant", "again"), (None, 1, "user", "x"), (None, 1, "assistant", "y")]
    turns += [(99, t, "assistant" if t % 2 else "user", f"turn {t} of a long one ") for t in range(400)]
    df = clashing(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5), "ids", "loss", "piece")
    pieces = store(chat.formatted(df, piece_chars=piece), "chat")
    assert piece > 50 or pieces.where("conv_id = 99").count() > 50
    found = chat.digest(pieces)
    assert rows(found, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == chat_rows(turns)
    assert found.where("formatted_chars < loss_chars OR n_ids < 2 * n_turns").count() == 0


def test_chat_of_nothing(spark):
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(store(chat.formatted(nothing), "chat")).count() == 0


# --- source divergence


def diverged(documents):
    lower = str.maketrans(divergence.CAPITALS, divergence.CAPITALS.lower())
    groups, held, counts = set(), Counter(), Counter()
    for text, lang, source in documents:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        held.update((lang, w) for w in set(words))
        counts.update((lang, source, w) for w in words)
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(w for (g, w), n in held.items() if g == lang and n >= 3)
        sources = [s for g, s in groups if g == lang]
        sums = {s: sum(counts[lang, s, w] for w in kept) for s in sources}

        def p(n, total, v=len(kept)):
            return 1 + 10**9 * (n + 1) // (total + v)

        for s in sources:
            mine = {w: p(counts[lang, s, w], sums[s]) for w in kept}
            pairs = [(sum((mine[w] - q) ** 2 // q for w in kept for q in [p(counts[lang, o, w], sums[o])]), o) for o in sources if o != s]
            terms = []
            for w in kept:
                q = p(sum(counts[lang, o, w] for o in sources), sum(sums.values()))
                if counts[lang, s, w] and mine[w] > q:
                    terms.append(((mine[w] - q) ** 2 // q, w))
            for part, found, top in (("pair", pairs, None), ("term", terms, 200)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found[:top], 1)]
    return Counter(out)


def test_divergence(docs):
    wide = clashing(docs, "terms", "slice", "index", "folder", "count", "n", "v")
    found = divergence.audit(wide)
    want = diverged([tuple(r) for r in docs.select("text", "lang", "source").collect()])
    assert rows(found, "lang", "source", "part", "item", "value", "rank") == want


def test_divergence_in_slices_and_blocks(spark, sample, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 64)
    documents = [tuple(r) for r in sample.select("text", "lang", "source").collect()]
    documents += [("none of this comes three times", "xx", "a"), (None, "xx", "b"), ("", "yy/=", "a"), ("alone", None, None)] * 2
    df = spark.createDataFrame(documents, "text string, lang string, source string")
    found = divergence.audit(df, slice_terms=1000)
    assert rows(found, "lang", "source", "part", "item", "value", "rank") == diverged(documents)


def test_divergence_groups_documents_by_source(spark):
    """A task holds whole sources (unless they are large), so what it sums up is sent once a source, not once a task."""
    docs = spark.range(0, 400, 1, 4).selectExpr("id AS doc_id", "'en' AS lang", "concat('s', id % 8) AS source", "'a b' AS text")
    rows = divergence.rows_of(docs).select("source", F.spark_partition_id().alias("part")).collect()
    assert len(rows) == 400 and len({(r.source, r.part) for r in rows}) == 8


def test_divergence_shares_and_letters_are_exact(spark):
    large = 2**63 // 10**9
    counts = [0, 1, 7, large - 2, large - 1, large, large + 1, 10**15]
    rows = spark.createDataFrame([(c, t) for c in counts for t in (1, 3, 10**12 + 7, 2**62)], "c long, t long")
    rows = rows.where("c < 1000000000 OR t > 1000000")  # as a count is below its total
    for c, t, p in rows.select("c", "t", divergence.share(F.col("c"), F.col("t"))).collect():
        assert p == 1 + 10**9 * (c + 1) // t
    texts = ["", "ABC xYz", "ÀÉ İI ẞ ΑΣ A", "Kelvin K K"]
    found = spark.createDataFrame([(t,) for t in texts], "text string").select("text", divergence.lowered(F.col("text"))).collect()
    assert [r[1] for r in found] == [t.translate({i: i + 32 for i in range(65, 91)}) for t in (r.text for r in found)]
