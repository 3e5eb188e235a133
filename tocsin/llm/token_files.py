"""Token-id files: frequency-ranked ids, one to four bytes each, with the byte counts in control bytes apart.

Every id is replaced by its rank among the corpus's ids by frequency, so that the 256 most frequent take
one byte. Two bits per id say how many bytes it takes; four of these make a control byte. A file is a
Spark-written parquet part whose rows are blocks of whole documents in ascending doc_id order: the
documents' ids and lengths, the control bytes and the data bytes. Decoding looks each control byte up in
a table of 256 rows and gathers the data bytes with numpy. The rank table lies beside the blocks.

Documents are tokenized once into a stored table; counting, ordering and writing read that table. Order
comes from a range partitioning by (doc_id, place in the stored table), which splits any number of rows
with one doc_id.

Defined results: a null text counts as empty (only the end id); an empty table gives files without rows;
a null doc_id comes first; repeated ids and rows are separate documents; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm.shared import id_and_text, map_batches, new_folder, slices, store, text_encoder

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
BLOCK_TOKENS = 1_000_000  # a block ends with the document that reaches this
FILE_TOKENS = 8_000_000  # tokens of a file, about
COUNTS = -1

BLOCK = (
    "part int, block int, start long, doc_ids array<long>, lengths array<long>, n long, control binary, data binary"
)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks below 2**32."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    code = (ranks > 0xFF).view(np.uint8)
    for limit in (0xFFFF, 0xFFFFFF):
        if ranks.max(initial=0) > limit:
            code = code + (ranks > limit)
    four = np.concatenate([code, np.zeros(-len(code) % 4, np.uint8)]).reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    kept = kept_bytes(code)
    return control.astype(np.uint8).tobytes(), ranks.astype(f"<u{kept.shape[1]}").view(np.uint8)[kept.reshape(-1)].tobytes()


def kept_bytes(code: np.ndarray) -> np.ndarray:
    """Which bytes of each rank are data, of as many (1, 2 or 4) as the longest needs; code: bytes of a rank less one."""
    most = int(code.max(initial=0))
    kept = np.ones((len(code), 4 if most > 1 else most + 1), bool)
    for k in range(1, kept.shape[1]):
        kept[:, k] = code >= k
    return kept


#: By control byte: how many data bytes each of its four ranks takes beyond one.
CODES = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8)


def decode_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    kept = kept_bytes(CODES[np.frombuffer(control, np.uint8)].reshape(-1)[:count])
    out = np.zeros(kept.size, np.uint8)
    out[kept.reshape(-1)] = np.frombuffer(data, np.uint8)
    return out.view(f"<u{kept.shape[1]}").astype(np.uint32)


def tokenized(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Stored table of doc_id, ids and the row's place (part, idx).

    Each task adds a row of idx COUNTS: how often it has met each id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer, False)
        part, idx = TaskContext.get().partitionId(), 0
        end = np.array([end_id], encoder.code).tobytes()
        counts = np.zeros(max(encoder.tokenizer.get_vocab_size(), end_id + 1), np.int64)
        for batch in slices(batches):
            ids = [x + end for x in encoder.ids(batch.column("text").to_pylist())]
            counts += np.bincount(ids_of(b"".join(ids), encoder.width), minlength=len(counts))
            yield rows(batch.column("doc_id"), ids, encoder.width, part, range(idx, idx + len(ids)))
            idx += len(ids)
        if idx:
            yield rows(pa.array([None], pa.int64()), [counts.tobytes()], 8, part, [COUNTS])

    def rows(doc_ids, ids, width, part, places) -> pa.RecordBatch:
        n = len(ids)
        columns = [pa.array(ids, pa.binary()), pa.array([width] * n, pa.int32()), pa.array([part] * n, pa.int32())]
        return pa.RecordBatch.from_arrays([doc_ids, *columns, pa.array(places, pa.int64())], names)

    schema = "doc_id long, ids binary, width int, part int, idx long"
    names = [c.split()[0] for c in schema.split(", ")]
    return store(map_batches(id_and_text(docs), run, schema), "ids")


def ids_of(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4")


def id_counts(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs: as many numbers as the vocabulary has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column("ids").to_pylist():
                counts = np.frombuffer(raw, np.int64)
                total = counts + total if len(total) else counts
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counted = map_batches(tokens.where(F.col("idx") == COUNTS).select("ids"), run, "id long, n long")
    return {r["id"]: r["n"] for r in counted.groupBy("id").agg(F.sum("n").alias("n")).collect()}


def write_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Tokenize all documents and write `folder`/blocks and `folder`/ranks."""
    spark = docs.sparkSession
    tokens = tokenized(docs, tokenizer, end_id)
    counts = id_counts(tokens)
    by_rank = sorted(counts, key=lambda i: (-counts[i], i))
    ranks = spark.createDataFrame(list(enumerate(by_rank)), "rank long, id long")
    ranks.coalesce(1).write.parquet(f"{folder}/ranks")
    table = np.zeros(max(by_rank, default=0) + 1, np.uint32)
    table[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    rank_of = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def written() -> pa.RecordBatch:
            lengths = [len(x) for _, x in held]
            control, data = encode_ranks(rank_of.value[np.concatenate([x for _, x in held])])
            values = [part, block, start, [d for d, _ in held], lengths, size, control, data]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names
            )

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "ids", "width"))
            for doc, raw, width in zip(*columns, strict=True):
                held.append((doc, ids_of(raw, width)))
                size += len(held[-1][1])
                if size >= BLOCK_TOKENS:
                    yield written()
                    block, start, held, size = block + 1, start + size, [], 0
        if held:
            yield written()

    names = [c.split()[0] for c in BLOCK.split(", ")]
    longs = pa.list_(pa.int64())
    types = [pa.int32(), pa.int32(), pa.int64(), longs, longs, pa.int64(), pa.binary(), pa.binary()]
    files = max(1, -(-sum(counts.values()) // FILE_TOKENS))
    keys = ["doc_id", "part", "idx"]
    kept = tokens.where(F.col("idx") != COUNTS)
    ordered = kept.repartitionByRange(files, *keys).sortWithinPartitions(*keys).select("doc_id", "ids", "width")
    map_batches(ordered, run, BLOCK).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_files(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (, ids as unsigned 32-bit) of every document, from the files."""
    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    # a few numbers per file: how many tokens the files before it hold
    totals = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    bases, total = {}, 0
    for part in sorted(totals):
        bases[part] = total
        total += totals[part]
    by_rank = [r["id"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()]
    known = spark.sparkContext.broadcast((bases, np.array(by_rank, "<u4")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, ids_by_rank = known.value
        for batch in batches:
            for row in batch.to_pylist():
                ids = ids_by_rank[decode_ranks(row["control"], row["data"], row["n"])]
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                own = [ids[i:j] for i, j in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(bases[row["part"]] + row["start"] + ends - lengths),
                    pa.array(lengths),
                    pa.array([zlib.crc32(x) for x in own], pa.int64()),
                ]
                if keep_ids:
                    columns.append(pa.array([x.tobytes() for x in own], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    names = [c.split()[0] for c in schema.split(", ")]
    return map_batches(blocks, run, schema)


def written_and_read(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write the files to the shared folder and give what reading them back says of each document."""
    folder = new_folder(docs.sparkSession, "token-files")
    write_files(docs, folder, tokenizer, end_id)
    return read_files(docs.sparkSession, folder)
