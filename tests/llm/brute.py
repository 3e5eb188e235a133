"""Plain restatements of what the queries return, one document at a time."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

SECRETS = {
    "assign": re.compile(
        r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def secrets(text):
    """Base spans (start, order, kind, end) of a text."""
    found = []
    for order, (kind, pattern) in enumerate(SECRETS.items()):
        for m in pattern.finditer(text or ""):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                found.append((m.start(), order, kind, m.end()))
    return sorted(found)


def secrets_row(text):
    found = secrets(text)
    said = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in found)
    counts = Counter(x[2] for x in found)
    return (*(counts[k] for k in SECRETS), hashlib.sha256(said.encode()).hexdigest())


def quality_row(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(inside),
        failed,
    )


PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def license_row(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = []
    for label, phrase in PHRASES.items():
        wanted = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
    starts = [i for i, _ in found]
    labels = ",".join(sorted({x for _, x in found}))
    return len(words), len(found), min(starts, default=None), max(starts, default=None), labels


def license_templates(text, templates, slack):
    """Labels and best share of words in place, looking for every template at every place."""

    def split(t):
        return re.findall(r"[a-z0-9]+", t.lower())

    words, labels, best = split(text or ""), set(), 0.0

    def stands(phrase, at):
        return at >= 0 and words[at : at + len(phrase)] == phrase

    for t in templates:
        whole, keys = split(t.text), [split(k) for k in t.keys or (t.text,)]
        places = [next(i for i in range(len(whole)) if whole[i : i + len(k)] == k) for k in keys]
        for i in range(len(words)):
            if not stands(keys[0], i):
                continue
            start, shifts = i - places[0], [0]
            for k, at in zip(keys[1:], places[1:]):
                shifts.append(next((s for s in sorted(range(-slack, slack + 1), key=abs) if stands(k, start + at + s)), None))
            if None in shifts:
                continue
            where = [{start + s + j for s in shifts} for j in range(len(whole))]
            same = sum(any(0 <= p < len(words) and words[p] == w for p in ps) for w, ps in zip(whole, where))
            labels.add(t.label)
            best = max(best, same / len(whole))
    return ",".join(sorted(labels)), round(best, 9)


def pieces(ids, capacity=2048, end_id=0):
    """(piece, start, length, crc) of a document with these ids."""
    ids = [*ids, end_id]
    return [
        (k, at, len(ids[at : at + capacity]), zlib.crc32(np.array(ids[at : at + capacity], "<u4").tobytes()))
        for k, at in enumerate(range(0, len(ids), capacity))
    ]


def shingle_weights(text, idf, width=5):
    words = re.findall(r"\w+", (text or "").lower())
    width = min(width, len(words)) or 1
    found = Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    return {s: n * idf(s) for s, n in found.items()}


def weighted_jaccard(a, b):
    keys = a.keys() | b.keys()
    top = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / top if top else 1.0
