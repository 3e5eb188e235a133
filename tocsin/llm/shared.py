"""What the operators share: reading documents, stored tables, tokenizer files, chunked encoding."""

from __future__ import annotations

import gc
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.session import shared_folder, ship_package

SLICE_CHARS = 1_000_000  # texts handled at once inside a task
CACHED_CHUNKS = 1_000_000  # entries of a worker's cache of encoded chunks
MARK = "\u2603"  # stands between chunks that are encoded together
ALONE = "alone"  # in place of bytes: the text with this chunk is encoded whole
CLOSING = ".,;:!?#$%&*"  # characters behind a word that it is parted from
LETTERS_END = "\u0250"  # letters below are the same in every version of Unicode and under NFC


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, null_text: str | None = "") -> DataFrame:
    """Only doc_id and text, so that no other column can clash; a null text becomes `null_text`."""
    text = F.col("text") if null_text is None else F.coalesce(F.col("text"), F.lit(null_text))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under the folder that the driver and all executors share."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write `df` once in the shared folder and read it back: cuts the lineage for lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Stored tables that are given up when nothing reads them any more; what is left goes with `close`."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        self.names: dict[str, str] = {}  # of bucketed tables, by path

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = new_folder(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(found)] = (found, path)
        return found

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """Like `store`, but in buckets by `key`: joins on it, however many, don't shuffle this table again."""
        path, table = new_folder(self.spark, name), f"{name}_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(table)
        found = self.spark.table(table)
        self.paths[id(found)] = (found, path)
        self.names[path] = table
        return found

    def drop(self, *stored: DataFrame) -> None:
        """Delete these tables' files, which this object wrote."""
        for df in stored:
            _, path = self.paths.pop(id(df), (None, None))
            if path:
                if path in self.names:
                    self.spark.sql(f"DROP TABLE {self.names.pop(path)}")
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        self.drop(*[df for df, _ in list(self.paths.values())])


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str):
    """`mapInArrow` with this package on the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most SLICE_CHARS bytes of text (or a single longer row)."""
    for batch in batches:
        at, size = 0, 0
        lengths = [0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()]
        for row, length in enumerate(lengths):
            if size and size + length > SLICE_CHARS:
                yield batch.slice(at, row - at)
                at, size = row, 0
            size += length
        if batch.num_rows > at:
            yield batch.slice(at)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equality join on `keys` in which null equals null; the sides are aliased l and r."""
    condition = F.lit(True)
    for key in keys:
        condition &= F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    return left.alias("l").join(right.alias("r"), condition, how)


# Byte-level vocabularies spell a byte as its Latin-1 character where that is printable, and the others,
# in order, by the characters from U+0100 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLING = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTED)}


class Chunks:
    """What short chunks of text are encoded to, each worked out once per worker.

    `encode(chunks)` gives the bytes of new chunks, or ALONE for one that can't stand for itself.
    """

    def __init__(self, encode: Callable[[list[str]], dict[str, bytes | str]]):
        self.encode = encode
        self.known = Known()

    def joined(self, texts: list[list[str]]) -> list[bytes | None]:
        """The bytes of each list of chunks in turn; None if one of them can't stand for itself."""
        if len(self.known) > CACHED_CHUNKS:
            self.known.clear()
        look, new = self.known.__getitem__, self.known.new
        found, missed = [], []
        for chunks in texts:
            before = len(new)
            found.append(list(map(look, chunks)))
            if len(new) > before:
                missed.append((len(found) - 1, before, len(new)))
        if new:
            self.known.update(self.encode(list(dict.fromkeys(new))))
            for k, i, j in missed:  # `new` has the chunks without bytes in the order of their places
                filled = map(look, new[i:j])
                found[k] = [next(filled) if x is None else x for x in found[k]]
            new.clear()
        return [joined_bytes(f) for f in found]


class Known(dict):
    """Encoded chunks. Those looked up in vain are listed in `new`, so that hits cost no more than the lookup."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> None:
        self.new.append(chunk)


def joined_bytes(found: list[bytes | str]) -> bytes | None:
    """All joined; None if ALONE, which is text, is among them."""
    try:
        return b"".join(found)  # type: ignore[arg-type]
    except TypeError:
        return None


def stands_alone(part: str) -> bool:
    """Whether a part behind a blank or a line end is cut off safely: no other white space at its edges."""
    return bool(part[part[:1] == "\n" :][:1].strip() and part[-1:].strip())


class BlankChunks:
    """Encodes whole texts by chunks, for tokenizers that keep a blank with the word behind it.

    A text is cut at each blank and before each line end. A cut is safe where that white space stands
    alone between other characters, since no token then crosses it; a text with any other white space at
    a cut is encoded whole. `whole(strings)` gives the bytes of each string, `parts(new)` those of parts
    with the blank before them (a part that begins with a line end has none), or ALONE.
    """

    def __init__(self, whole: Callable[[list[str]], list[bytes]], parts: Callable[[list[str]], dict[str, bytes | str]]):
        self.whole = whole
        self.first = Chunks(lambda new: dict(zip(new, whole(new), strict=True)))
        self.rest = Chunks(parts)

    def ids(self, texts: list[str]) -> list[bytes]:
        parts = [t.replace("\n", " \n").split(" ") for t in texts]
        starts = self.first.joined([p[:1] if p[0][-1:].strip() else [] for p in parts])
        rests = self.rest.joined([p[1:] for p in parts])
        out = []
        for text, part, start, rest in zip(texts, parts, starts, rests, strict=True):
            safe = rest is not None and (part[0][-1:].strip() or not text)
            out.append(start + rest if safe else self.whole([text])[0])  # type: ignore[operator]
        return out


def with_blank(part: str) -> str:
    return part if part[:1] == "\n" else " " + part


class TextEncoder:
    """Token ids of whole texts by the tokenizers library, as unsigned integers of `width` bytes each.

    `by_word`: the tokenizer drops white space and no token crosses it, so a text is cut at blanks, line
    ends and tabs. Otherwise it is cut as BlankChunks does. Either way the ids are those of the text.
    """

    def __init__(self, path: str, by_word: bool, markers: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # a text that may hold a special token's string goes whole through the plain call, if that is to be an id
        special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if markers and special else None
        self.lead = os.path.commonprefix(special).partition("<|")[1]  # without letters, so in any case alike
        self.by_word = by_word
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "<u2" if self.width == 2 else "<u4"
        self.stems: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.merge, self.lead_blank = self.tokenizer.model.tokenize, "" if by_word else chr(SPELLING[32])
        self.raw = [i.to_bytes(self.width, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words = Chunks(self.encode_parts)
        self.blanks = BlankChunks(self.encode_marked, self.encode_parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.code).tobytes() for x in found]

    def encode_parts(self, parts: list[str]) -> dict[str, bytes | str]:
        """Words of letters and closing punctuation from `stems` and `tails`, other parts one by one."""
        if len(self.stems) > CACHED_CHUNKS:
            self.stems.clear()
        stem_of, tail_of = self.stems.get, self.tails.get
        out: dict[str, bytes | str] = {}
        rest = []
        for c in parts:
            w = c.rstrip(CLOSING)
            stem = stem_of(w)
            if stem is None:
                if not w.isalpha() or not w.isascii() and max(w) >= LETTERS_END:
                    rest.append(c)
                    continue
                stem = self.encode_stem(w)
            if len(w) < len(c):
                end = c[len(w) :]
                tail = tail_of(end)
                if tail is None:
                    tail = self.tails[end] = self.encode([end])[0]
                stem += tail
            out[c] = stem
        if self.by_word:
            out.update(zip(rest, self.encode_marked(rest), strict=True))
        else:
            out.update((c, ALONE) for c in rest if not stands_alone(c))
            rest = [c for c in rest if c not in out]
            out.update(zip(rest, self.encode_marked([with_blank(c) for c in rest]), strict=True))
        return out

    def encode_stem(self, stem: str) -> bytes:
        """A word of letters only: its bytes (and the blank's) spelled as the vocabulary does, then merged."""
        spelled = stem.lower() if self.by_word else stem
        if not spelled.isascii():
            spelled = spelled.encode().decode("latin-1").translate(SPELLING)
        raw = self.raw
        found = self.stems[stem] = b"".join([raw[t.id] for t in self.merge(self.lead_blank + spelled)])
        return found

    def encode_marked(self, chunks: list[str]) -> list[bytes]:
        """Other chunks. MARK stands between them in longer texts: far cheaper than a call each.

        No token joins the mark with its neighbours: a blank stands before it, and behind it white space,
        a letter or, for `by_word`, a blank. Other chunks, and any that hold the mark, are encoded apart.
        """
        plain = [c for c in chunks if MARK not in c and (self.by_word or c[:1].isspace() or c[:1].isalpha())]
        if not self.by_word:
            plain = [c for c in plain if c[-1:].strip() and (c[:1].isalpha() or c[1:2].strip())]
        out, mark = {}, " " + MARK + (" " if self.by_word else "")
        own = np.frombuffer(self.encode([" " + MARK])[0], self.code)
        groups = [plain[at : at + 1000] for at in range(0, len(plain), 1000)]
        for group, raw in zip(groups, self.encode([mark.join([*g, ""]) for g in groups]), strict=True):
            ids = np.frombuffer(raw, self.code)
            here = np.ones(len(ids) - len(own) + 1, bool)
            for k, value in enumerate(own):
                here &= ids[k : k + len(here)] == value
            ends = np.nonzero(here)[0]
            starts = np.concatenate([[0], ends[:-1] + len(own)])
            spans = zip((starts * self.width).tolist(), (ends * self.width).tolist(), strict=True)
            out.update(zip(group, [raw[i:j] for i, j in spans], strict=True))
        rest = [c for c in chunks if c not in out]
        out.update(zip(rest, self.encode(rest), strict=True))
        return [out[c] for c in chunks]

    def ids(self, texts: list[str]) -> list[bytes]:
        marked = [i for i, t in enumerate(texts) if self.special and self.lead in t and self.special.search(t.lower())]
        if not marked:
            return self.unmarked(texts)
        here = set(marked)
        plain = iter(self.unmarked([t for i, t in enumerate(texts) if i not in here]))
        self.tokenizer.encode_special_tokens = False
        found = iter(self.encode([texts[i] for i in marked]))
        self.tokenizer.encode_special_tokens = True
        return [next(found if i in here else plain) for i in range(len(texts))]

    def unmarked(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.blanks.ids(texts)
        lower = [t.lower() if t.isascii() else t for t in texts]  # as the tokenizer does
        return self.words.joined([t.replace("\n", " ").replace("\t", " ").split(" ") for t in lower])


_kept: dict[str, dict] = {}


def kept_by(owner: str) -> dict:
    """What the worker keeps between tasks for one operator; what another one has left there is given up."""
    if owner not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _kept[owner] = {}
    return _kept[owner]


def text_encoder(name: str, by_word: bool, markers: bool = True) -> TextEncoder:
    """The worker's encoder for a tokenizer file, kept with its cache between tasks.

    `markers`: strings of special tokens in a text become their ids, as the library's plain call has it.
    """
    key, encoders = (name, by_word, markers), kept_by("encoders")
    if key not in encoders:
        encoders[key] = TextEncoder(name if "/" in name else tokenizer_path(name), by_word, markers)
    return encoders[key]
