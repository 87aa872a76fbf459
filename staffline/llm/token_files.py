"""Token ids in files of patched frame-of-reference blocks.

The ids of all documents, in the order of their doc_ids, are cut into blocks of ``BLOCK``
ids. A block stores its smallest id, and of each id the difference to it in a fixed number
of bits: as many as the ``PERCENTILE``-th percentile of the differences needs. Larger
differences are exceptions: they are listed whole behind the block, with their places, and
patched in on reading. The starts of the blocks are indexed, so any block can be decoded
by itself.

Documents are dealt to tasks by ranges of doc_id and put in order there. A task writes
segments of about ``SEGMENT_IDS`` ids, one row each of a Parquet table (Spark has no
writer for raw files, and the shared folder may be any store): file number, segment
number, ids and documents in it, and the segment itself as bytes::

    "PFR1", n_docs u32, n_ids u64, n_blocks u32
    doc_id i64 * n_docs, is-null u8 * n_docs, ids u32 * n_docs      the documents
    start u32 * n_blocks                                            the block index
    blocks: smallest u32, ids u16, bits u8, exceptions u16;
            bit planes, ceil(ids / 8) bytes each; places u16, differences u32

All numbers are least significant byte first. A document's place among all ids is the sum
of the ids of the files and segments before, from their row counts alone, plus its place
in the segment. Long documents may fill a segment by themselves.

Nulls: a null text is empty and has the end id alone; null doc_ids come first. Rows that
repeat a doc_id stand next to each other, ordered by text. An empty table gives a table
without segments. Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staffline.llm.tokens import encoder, tokenizer_path
from staffline.llm.words import as_bytes
from staffline.session import staged

BLOCK = 256
PERCENTILE = 95
SEGMENT_IDS = 1 << 20
END_ID = 2
MAGIC = b"PFR1"
_HEAD = struct.Struct("<4sIQI")
_BLOCK_HEAD = np.dtype([("least", "<u4"), ("n", "<u2"), ("bits", "u1"), ("exceptions", "<u2")])


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """One byte string for each block of ``BLOCK`` ids; the last block may be shorter."""
    out: list[bytes] = []
    whole = len(ids) // BLOCK * BLOCK
    for part in (ids[:whole].reshape(-1, BLOCK), ids[whole:].reshape(1, -1)):
        if part.size:
            out += _encode_equal(part.astype(np.uint32))
    return out


def _encode_equal(rows: np.ndarray) -> list[bytes]:
    n = rows.shape[1]
    least = rows.min(axis=1)
    differences = rows - least[:, None]
    rank = min(n - 1, n * PERCENTILE // 100)
    covered = np.partition(differences, rank, axis=1)[:, rank]
    bits = np.ceil(np.log2(covered.astype(np.float64) + 1)).astype(np.int64)
    limit = np.left_shift(np.uint64(1), bits.astype(np.uint64))
    beyond = differences >= limit[:, None]
    kept = np.where(beyond, 0, differences).astype(np.uint32)
    heads = np.zeros(len(rows), _BLOCK_HEAD)
    heads["least"], heads["n"], heads["bits"], heads["exceptions"] = least, n, bits, beyond.sum(axis=1)
    planes = [np.packbits((kept >> np.uint32(b)).astype(np.uint8) & 1, axis=1, bitorder="little") for b in range(int(bits.max(initial=0)))]
    stacked = np.stack(planes, axis=1) if planes else np.zeros((len(rows), 0, 1), np.uint8)
    out = []
    for row in range(len(rows)):
        place = np.flatnonzero(beyond[row]).astype("<u2") if heads["exceptions"][row] else np.zeros(0, "<u2")
        out.append(heads[row].tobytes() + stacked[row, : bits[row]].tobytes() + place.tobytes() + differences[row, place].astype("<u4").tobytes())
    return out


def decode_block(data: bytes, start: int = 0) -> np.ndarray:
    """The ids of the block that begins at ``start``."""
    head = np.frombuffer(data, _BLOCK_HEAD, 1, start)[0]
    n, bits, exceptions = int(head["n"]), int(head["bits"]), int(head["exceptions"])
    at, width = start + _BLOCK_HEAD.itemsize, (n + 7) // 8
    planes = np.unpackbits(np.frombuffer(data, np.uint8, bits * width, at).reshape(bits, width), axis=1, count=n, bitorder="little")
    ids = np.zeros(n, np.uint32)
    for b in range(bits):
        ids |= planes[b].astype(np.uint32) << np.uint32(b)
    at += bits * width
    place = np.frombuffer(data, "<u2", exceptions, at)
    ids[place] = np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions)
    return ids + head["least"]


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """All ids of a segment's blocks; whole blocks of one width are decoded together."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    heads = raw[starts[:, None] + np.arange(_BLOCK_HEAD.itemsize)].copy().view(_BLOCK_HEAD)[:, 0]
    ids = np.zeros((len(starts), BLOCK), np.uint32)
    begin = starts + _BLOCK_HEAD.itemsize
    full = heads["n"] == BLOCK
    width = BLOCK // 8
    for bits in np.unique(heads["bits"][full]):
        which = np.flatnonzero(full & (heads["bits"] == bits))
        packed = raw[begin[which, None] + np.arange(int(bits) * width)].reshape(len(which), int(bits), width)
        values = np.zeros((len(which), BLOCK), np.uint32)
        for b in range(int(bits)):
            values |= np.unpackbits(packed[:, b], axis=1, bitorder="little").astype(np.uint32) << np.uint32(b)
        ids[which] = values
    for row in np.flatnonzero(full & (heads["exceptions"] > 0)):
        n, at = int(heads["exceptions"][row]), int(begin[row]) + int(heads["bits"][row]) * width
        ids[row, np.frombuffer(data, "<u2", n, at)] = np.frombuffer(data, "<u4", n, at + 2 * n)
    ids[full] += heads["least"][full, None]
    flat = [ids[full].ravel()]
    flat += [decode_block(data, int(s)) for s in starts[~full]]  # the last one at most
    return np.concatenate(flat)


def encode_segment(keys: list[int | None], parts: list[np.ndarray]) -> bytes:
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    blocks = encode_blocks(ids)
    sizes = np.array([len(b) for b in blocks], np.int64)
    return b"".join([
        _HEAD.pack(MAGIC, len(keys), len(ids), len(blocks)),
        np.array([k or 0 for k in keys], "<i8").tobytes(), np.array([k is None for k in keys], np.uint8).tobytes(),
        np.array([len(p) for p in parts], "<u4").tobytes(), (np.cumsum(sizes) - sizes).astype("<u4").tobytes(), *blocks,
    ])


def decode_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, number of ids of each document, and all ids."""
    magic, n_docs, n_ids, n_blocks = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = _HEAD.size
    keys = np.frombuffer(data, "<i8", n_docs, at)
    null = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
    counts = np.frombuffer(data, "<u4", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 13 * n_docs
    starts = np.frombuffer(data, "<u4", n_blocks, at).astype(np.int64)
    ids = decode_blocks(data[at + 4 * n_blocks :], starts)
    if len(ids) != n_ids or counts.sum() != n_ids:
        raise ValueError("a segment of token ids is damaged")
    return [None if x else int(k) for k, x in zip(keys, null, strict=True)], counts, ids


_SEGMENTS = "file int, segment int, n_docs bigint, n_ids bigint, data binary"


def segments(ordered: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``ordered``: doc_id, text; each partition becomes a file."""

    def write(batches) -> Iterator[pa.RecordBatch]:
        file, number = TaskContext.get().partitionId(), 0
        encode, end = encoder(tokenizer).encode, np.array([end_id], np.uint32)
        keys: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def full() -> pa.RecordBatch:
            data = encode_segment(keys, parts)
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([number], pa.int32()), pa.array([len(keys)]), pa.array([held]), pa.array([data], pa.binary())],
                names=["file", "segment", "n_docs", "n_ids", "data"])

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encode(as_bytes(batch.column(1))), strict=True):
                keys.append(key)
                parts.append(np.concatenate([ids, end]))
                held += len(parts[-1])
                if held >= SEGMENT_IDS:
                    yield full()
                    keys, parts, held, number = [], [], 0, number + 1
        if keys:
            yield full()

    return ordered.mapInArrow(write, _SEGMENTS)


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode the texts of ``docs`` (doc_id, text) and write them under ``path``."""
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    segments(ordered, tokenizer or tokenizer_path(), end_id).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens and ids (32-bit numbers as bytes)."""
    table = spark.read.parquet(path)
    sizes = table.select("file", "segment", "n_ids")
    # One row per file; files are as many as tasks.
    files = sizes.groupBy("file").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("file_start"))
    within = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("in_file", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(files, "file").select(
        "file", "segment", (F.col("file_start") + F.col("in_file")).alias("segment_start"))

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, segment, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys, counts, ids = decode_segment(data)
                until = np.cumsum(counts)
                raw = ids.astype("<u4").tobytes()
                texts = [raw[4 * (u - n) : 4 * u] for u, n in zip(until, counts, strict=True)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array(keys, pa.int64()),
                     pa.array(until - counts), pa.array(counts), pa.array(texts, pa.binary())],
                    names=["file", "segment", "doc_id", "in_segment", "n_tokens", "ids"])

    docs = table.select("file", "segment", "data").mapInArrow(
        read, "file int, segment int, doc_id bigint, in_segment bigint, n_tokens bigint, ids binary")
    # Written first, so that Spark knows that it is small and leaves the ids where they are.
    return docs.join(staged(starts), ["file", "segment"]).select(
        "doc_id", (F.col("segment_start") + F.col("in_segment")).alias("start"), "n_tokens", "ids")
