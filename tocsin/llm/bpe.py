"""Byte-level BPE by merge ranks, with a segment tree over byte positions.

Each leaf of the tree holds the rank of the pair that starts at its byte (joined with the position, so
that the least value is the leftmost pair of the least rank); the root gives the next merge. A merge
changes the pairs at the merged token and at its live neighbours, three point updates of logarithmic
cost. Many short pieces are encoded at once, a row of arrays for each; a long piece has a tree of its
own, so time stays n log n for any text. Repeated chunks of text are encoded once per worker.

Defined results: a null or empty text has no ids; repeated rows are encoded each; an empty table gives
an empty result; other columns are ignored. Every byte must be a token, as in all byte-level rank files.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tocsin.llm.shared import (
    ALONE,
    BlankChunks,
    id_and_text,
    map_batches,
    slices,
    stands_alone,
    tokenizer_path,
    with_blank,
)

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
NONE = np.int32(2**31 - 1)  # no pair here
TOGETHER = 64  # longest piece, in bytes, that is encoded among others
CELLS = 1 << 17  # leaves of the trees that are worked on at once


class BytePairCodec:
    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        self.find = regex.compile(pattern or public_tokenizers.PATTERN).findall
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.shift = np.int64(size.bit_length())
        self.pairs = {
            (self.ranks[t[:i]] << int(self.shift)) | self.ranks[t[i:]]: rank
            for t, rank in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        }
        self.pair_keys = np.array(sorted(self.pairs) or [-1], np.int64)
        self.pair_ranks = np.array([self.pairs.get(k, 0) for k in self.pair_keys.tolist()], np.int32)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.decimals = [str(i) for i in range(size)]
        self.blanks = BlankChunks(self.encode_texts, self.encode_parts)

    # encoding -------------------------------------------------------------

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the joined tokens, NONE where they don't join."""
        key = (left.astype(np.int64) << self.shift) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def encode_together(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Ids of pieces of at most `size` bytes (a power of two), merge by merge in lockstep."""
        count = len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        place = np.arange(size + 2, dtype=np.int32)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(count, size)
        token = np.full((count, size + 2), -1, np.int32)  # two cells beyond the end hold no token
        token[:, :size] = self.byte_ids[raw]
        token[place[None, :] >= lengths[:, None]] = -1
        after = np.minimum(np.tile(place + 1, (count, 1)), size)
        before = np.tile(place - 1, (count, 1))
        tree = np.full((count, 2 * size), NONE, np.int32)
        both = (token[:, :size] >= 0) & (token[:, 1 : size + 1] >= 0)
        rank = self.pair(token[:, :size][both], token[:, 1 : size + 1][both])
        tree[:, size:][both] = np.where(rank == NONE, NONE, rank * size + np.nonzero(both)[1])
        for top in (size >> k for k in range(1, size.bit_length())):
            tree[:, top : 2 * top] = np.minimum(tree[:, 2 * top : 4 * top : 2], tree[:, 2 * top + 1 : 4 * top : 2])
        live = np.nonzero(tree[:, 1] < NONE)[0] if size > 1 else np.empty(0, np.int64)
        while len(live):
            least = tree[live, 1]
            at = least % size
            gone = after[live, at]
            following = after[live, gone]
            previous = before[live, at]
            token[live, at], token[live, gone] = least // size, -1
            after[live, at] = following
            before[live, following] = at
            spots = np.stack([at, gone, np.maximum(previous, 0)], 1)
            own, mine, theirs = token[live, at], token[live, previous], token[live, following]
            new = np.full(spots.shape, NONE, np.int32)
            some = theirs >= 0
            rank = self.pair(own[some], theirs[some])
            new[some, 0] = np.where(rank == NONE, NONE, rank * size + at[some])
            some = (previous >= 0) & (mine >= 0)
            rank = self.pair(mine[some], own[some])
            new[some, 2] = np.where(rank == NONE, NONE, rank * size + previous[some])
            new[~some, 2] = new[~some, 0]  # no neighbour on the left: position 0 is the merged token
            rows = live[:, None]
            tree[rows, size + spots] = new
            node = (size + spots) >> 1
            while node[0, 0]:
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node >>= 1
            live = live[tree[live, 1] < NONE]
        kept = token[:, :size] >= 0
        raw = token[:, :size][kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.sum(1)) * 4).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends)]

    def encode_alone(self, piece: bytes) -> bytes:
        """Ids of one piece of any length; the same tree in plain lists."""
        n, pairs, shift = len(piece), self.pairs, int(self.shift)
        size, none = 1 << (n - 1).bit_length(), 1 << 62
        token = [self.ranks[piece[i : i + 1]] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def value(i: int, j: int) -> int:
            rank = pairs.get((token[i] << shift) | token[j]) if 0 <= i and j < n else None
            return none if rank is None else rank * size + i

        tree = [none] * size + [value(i, i + 1) for i in range(n)] + [none] * (size - n)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, new: int) -> None:
            node = size + i
            tree[node] = new
            while node := node >> 1:
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] < none:
            rank, at = divmod(tree[1], size)
            gone = after[at]
            token[at], token[gone], after[at] = rank, -1, after[gone]
            if after[at] < n:
                before[after[at]] = at
            put(gone, none)
            put(at, value(at, after[at]))
            if before[at] >= 0:
                put(before[at], value(before[at], at))
        return np.array([i for i in token if i >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece: its own rank where it has one, else by merges."""
        out: list[bytes | None] = [None] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > TOGETHER:
                out[i] = self.encode_alone(piece)
            else:
                by_size.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for size, members in by_size.items():
            for at in range(0, len(members), CELLS // size):
                some = members[at : at + CELLS // size]
                for i, ids in zip(some, self.encode_together([pieces[i] for i in some], size), strict=True):
                    out[i] = ids
        return out  # type: ignore[return-value]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids (unsigned 32-bit) of each text: every match of the pattern is encoded apart from the others."""
        matches = [[m.encode() for m in self.find(t)] for t in texts]
        pieces = list(dict.fromkeys(chain.from_iterable(matches)))
        ids = dict(zip(pieces, self.encode_pieces(pieces), strict=True))
        return [b"".join(map(ids.__getitem__, own)) for own in matches]

    def encode_parts(self, parts: list[str]) -> dict[str, bytes | str]:
        """Parts of texts with the blank before them; ALONE for one that isn't cut off safely."""
        safe = [p for p in parts if stands_alone(p)]
        return dict.fromkeys(parts, ALONE) | dict(
            zip(safe, self.encode_texts([with_blank(p) for p in safe]), strict=True)
        )

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(raw, "<u4") for raw in self.blanks.ids(texts)]

    # decoding -------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes in turn, gathered from one array of all tokens."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ids) else 0
        return self.bytes[np.arange(total) + np.repeat(self.offsets[ids] - (ends - lengths), lengths)].tobytes()


_codecs: dict[tuple[str, str | None], BytePairCodec] = {}


def codec(name: str = TOKENIZER, pattern: str | None = None) -> BytePairCodec:
    """The worker's codec of a rank file, kept with its cache between tasks."""
    key = (name, pattern)
    if key not in _codecs:
        _codecs[key] = BytePairCodec(name if "/" in name else tokenizer_path(name), pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, pattern)
        for batch in slices(batches):
            ids = [x.astype("<u4").tobytes() for x in own.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return map_batches(id_and_text(docs), run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, tokenizer: str = TOKENIZER, pattern: str | None = None) -> DataFrame:
    """doc_id and the decoded bytes of rows of `encode_documents`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, pattern)
        for batch in batches:
            raw = [own.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str | None = None) -> DataFrame:
    """Per document the count and digest of its ids and the digest of the bytes they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, pattern)
        for batch in slices(batches):
            counts, ids_digests, digests = [], [], []
            for ids in own.encode(batch.column("text").to_pylist()):
                decimal = ",".join(map(own.decimals.__getitem__, ids.tolist()))
                counts.append(len(ids))
                ids_digests.append(hashlib.sha256(decimal.encode()).hexdigest())
                digests.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()),
                 pa.array(digests, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(id_and_text(docs), run, schema)
