"""Chat formatting at token level, with loss masks, and its exact way back.

A turn becomes one reserved id for its opening, the ids of its text, and one reserved id for its end:

    ### Assistant:            also ### System: and ### User:; any other role opens with
    the text                  <turn>, the ids of the role's name, and <text>
    </turn>

Each segment is encoded apart from the reserved ids around it (byte-level BPE; strings that look like special tokens
are ordinary text), so no token spans a border and no text can yield a reserved id. Control strings inside a text or
role get a backslash in front. Control strings hold no backslash and can't overlap, so taking one backslash from each
that has one gives the text back, whatever backslashes it had; and a line end stands between a text and the controls
around it, so the rendered string can be parsed as well.

The loss mask is derived from the ids: a running sum over openings numbers the turns, and an id is under the mask if
it is no reserved one and its turn opened with the assistant's.

Conversations are sorted by range of (conv_id, turn), so one conversation may lie in many tasks; none is held whole.
Each task writes pieces of whole turns, of about `piece_chars` at most unless one turn is longer. Only a digest over
a conversation's whole text, which SHA-256 can only take in order, streams the pieces of a conversation that has
several through one task; others are digested where they are read.

Defined results: rows of a conversation go by turn (null first), then role, then text; null role or text is empty;
rows without conv_id are one conversation; repeated rows are turns of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.shared import PRINTED, SPELLING, map_batches, slices, text_encoder

TOKENIZER = "byte_bpe_50k.json"
PIECE_CHARS = 1_000_000

ROLES = {"system": "### System:", "user": "### User:", "assistant": "### Assistant:"}
OTHER, NAMED, END = "<turn>", "<text>", "</turn>"
CONTROLS = [*ROLES.values(), OTHER, NAMED, END]
RENDERED = [*(f"{x}\n" for x in ROLES.values()), OTHER, f"\n{NAMED}\n", f"\n{END}\n"]

_control = re.compile("|".join(map(re.escape, CONTROLS)))
_escaped = re.compile(r"\\(" + _control.pattern + ")")

PIECES = "conv_id long, part int, piece int, whole boolean, n_turns long, ids binary, loss binary"
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long"
)


def escape(text: str) -> str:
    return _control.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


class Template:
    """Token ids of turns and back; reserved ids follow the vocabulary."""

    def __init__(self, tokenizer: str):
        self.encoder = text_encoder(tokenizer, by_word=False, markers=False)
        vocabulary = self.encoder.tokenizer.get_vocab(with_added_tokens=True)
        self.first = max(vocabulary.values()) + 1
        self.reserved = {c: self.first + i for i, c in enumerate(CONTROLS)}
        byte_of = {chr(b): b for b in PRINTED} | {chr(c): b for b, c in SPELLING.items()}
        self.tokens = [b""] * self.first
        for token, i in vocabulary.items():
            self.tokens[i] = bytes(map(byte_of.__getitem__, token))
        openings = [*(self.reserved[x] for x in ROLES.values()), self.reserved[OTHER]]
        self.is_opening = np.zeros(self.first + len(CONTROLS), bool)
        self.is_opening[openings] = True

    def encode(self, strings: list[str]) -> list[np.ndarray]:
        code = self.encoder.code
        return [np.frombuffer(x, code).astype(np.uint32) for x in self.encoder.ids([escape(s) for s in strings])]

    def turns(self, roles: list[str], texts: list[str]) -> list[np.ndarray]:
        """The ids of each turn."""
        others = sorted({r for r in roles if r not in ROLES})
        named = dict(zip(others, self.encode(others), strict=True))
        out = []
        for role, ids in zip(roles, self.encode(texts), strict=True):
            if role in ROLES:
                head = [[self.reserved[ROLES[role]]]]
            else:
                head = [[self.reserved[OTHER]], named[role], [self.reserved[NAMED]]]
            out.append(np.concatenate([*head, ids, [self.reserved[END]]]).astype(np.uint32))
        return out

    def loss(self, ids: np.ndarray) -> np.ndarray:
        """Which ids are trained on."""
        opening = self.is_opening[ids]
        turn = np.cumsum(opening)
        learned = np.concatenate([[False], ids[opening] == self.reserved[ROLES["assistant"]]])
        return learned[turn] & (ids < self.first)

    def text(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode()

    def rendered(self, ids: np.ndarray) -> str:
        """The formatted string that the ids stand for."""
        spelled = [*self.tokens, *(x.encode() for x in RENDERED)]
        return b"".join(map(spelled.__getitem__, ids.tolist())).decode()

    def read(self, ids: np.ndarray, loss: np.ndarray) -> Iterator[tuple[str, str, str | None, int]]:
        """(role, text, text under the mask or None, formatted characters) of each turn."""
        by_id = {self.reserved[c]: role for role, c in ROLES.items()}
        size = dict(zip(self.reserved.values(), map(len, RENDERED), strict=True))
        starts = np.flatnonzero(self.is_opening[ids])
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
            own, mask = ids[i:j], loss[i:j]
            controls = np.flatnonzero(own >= self.first)
            bodies = [self.text(own[a + 1 : b].tolist()) for a, b in zip(controls[:-1].tolist(), controls[1:].tolist(), strict=True)]
            role = by_id.get(int(own[0]))
            chars = sum(map(len, bodies)) + sum(size[c] for c in own[controls].tolist())
            masked = unescape(self.text(own[mask].tolist())) if mask.any() or role == "assistant" else None
            yield unescape(bodies[0]) if role is None else role, unescape(bodies[-1]), masked, chars


_templates: dict[str, Template] = {}


def template(tokenizer: str) -> Template:
    """The worker's template for a tokenizer file."""
    if tokenizer not in _templates:
        _templates[tokenizer] = Template(tokenizer)
    return _templates[tokenizer]


def formatted(conversations: DataFrame, tokenizer: str = TOKENIZER, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Pieces of conversations: ids (little-endian unsigned 32-bit) and their loss mask (packed bits).

    Pieces of a conversation go by (part, piece); `whole`: the conversation has no other piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part = template(tokenizer), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        conv, size, piece, cut, first = None, 0, 0, False, True

        def emit(whole: bool) -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = (conv, part, piece, whole, len(held), ids.astype("<u4").tobytes(), np.packbits(made.loss(ids)).tobytes())
            types = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary())
            names = [c.split()[0] for c in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

        for batch in slices(batches):
            convs, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            for own, ids, text in zip(convs, made.turns(roles, texts), texts, strict=True):
                new = bool(held) and own != conv
                if new or size > piece_chars:
                    # the first conversation here may have begun in the task before, the last may go on in the next
                    yield emit(new and not cut and not first)
                    held, size, piece = [], 0, piece + 1
                    first, cut = first and not new, not new
                conv = own
                held.append(ids)
                size += len(text)
        if held:
            yield emit(False)

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_batches(dealt, run, PIECES)


def turns_of(row: tuple, made: Template) -> tuple[bytes, str, int]:
    """(what the digest takes of the turns, text under the mask, formatted characters) of a piece (ids, loss)."""
    ids = np.frombuffer(row[0], "<u4")
    loss = np.unpackbits(np.frombuffer(row[1], np.uint8), count=len(ids)).astype(bool)
    turns = list(made.read(ids, loss))
    said = "".join(f"{role}\n{text}\n" for role, text, _, _ in turns).encode()
    return said, "".join(x[2] for x in turns if x[2] is not None), sum(x[3] for x in turns)


def digest(pieces: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """What the stored pieces say of each conversation, read back from their ids and masks."""

    def read(batches: Iterator[pa.RecordBatch], stream: bool) -> Iterator[pa.RecordBatch]:
        """Rows of one conversation lie together, in order."""
        made, held, conv = template(tokenizer), None, None
        rows: list[tuple] = []

        def close() -> None:
            turns, said, masked, loss, chars, n_ids = held
            rows.append((conv, turns, said.hexdigest(), masked, loss.hexdigest(), chars, n_ids))

        for batch in batches:
            for own, n_turns, ids, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_turns", "ids", "loss")), strict=True):
                if held and (own != conv or not stream):
                    close()
                    held = None
                if not held:
                    conv, held = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                said, masked, chars = turns_of((ids, loss), made)
                held[1].update(said)
                held[3].update(masked.encode())
                for i, more in ((0, n_turns), (2, len(masked)), (4, chars), (5, len(ids) // 4)):
                    held[i] += more
            yield as_batch(rows)
            rows.clear()
        if held:
            close()
        yield as_batch(rows)

    columns = ("conv_id", "n_turns", "ids", "loss")
    alone = pieces.where("whole").select(*columns)
    parted = pieces.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").select(*columns)
    return map_batches(alone, lambda b: read(b, False), DIGEST).unionByName(map_batches(parted, lambda b: read(b, True), DIGEST))


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    names, types = zip(*((n, kinds[t]) for n, t in (c.split() for c in DIGEST.split(", "))), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))
