"""Token ids as patched frame-of-reference files, and back.

A shard file holds the documents of one interval of doc_ids, at most SHARD_IDS ids or one document:

    magic b"TMPF3\\n", then eight little-endian unsigned 64-bit numbers: documents, ids, blocks, ids a
    block, bytes of the block data, bytes of the whole file, how many documents, the first ones, have no doc_id, and the
    crc32 of all that follows;
    documents x (signed 64-bit doc_id, unsigned 64-bit ids of it);
    blocks x unsigned 64-bit start of the block in the block data;
    block data. A block: unsigned 32-bit minimum, 8-bit width, 16-bit count of exceptions, then its
    ids less the minimum packed at that width (low bits first, whole bytes), then the exceptions'
    16-bit positions and 32-bit full differences.

The width is that of the PERCENTILE of the block's differences; larger ones are exceptions. The
files are written by Spark's own committer, one row a file, so they reach any store Spark writes, and
are read by Spark's binaryFile source. (The text writer ends each file with one line feed; the
length in the header leaves it out.)
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import portions, shared_path, table, text_of, written

MAGIC = b"TMPF3\n"
BLOCK_IDS = 1024
PERCENTILE = 0.9
SHARD_IDS = 2_000_000
#: Characters per partition of the ordered table.
PART_CHARS = 8_000_000
#: Characters by which rows of equal doc_ids are dealt to partitions.
DEALT = 64
_HEAD = struct.Struct("<8Q")
_BLOCK = struct.Struct("<IBH")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values as bytes at `width` bits each."""
    bits = np.empty((*values.shape, width), np.uint8)
    for k in range(width):
        bits[..., k] = (values >> np.uint32(k)) & 1
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(data: np.ndarray, width: int, count: int) -> np.ndarray:
    bits = np.unpackbits(data, axis=1, bitorder="little", count=count * width).reshape(len(data), count, width)
    out = np.zeros((len(data), count), np.uint32)
    for k in range(width):
        out |= bits[..., k].astype(np.uint32) << np.uint32(k)
    return out


def encode_blocks(ids: np.ndarray, block_ids: int = BLOCK_IDS, percentile: float = PERCENTILE) -> list[bytes]:
    """Each block of ids (unsigned 32-bit; the last may be short) as bytes."""
    blocks: list[bytes] = [b""] * -(-len(ids) // block_ids)
    full = len(ids) // block_ids
    for first, part in ((0, ids[: full * block_ids].reshape(full, block_ids)), (full, ids[full * block_ids :].reshape(1, -1))):
        if part.size == 0:
            continue
        low = part.min(axis=1)
        diff = part - low[:, None]
        n = part.shape[1]
        at = max(0, int(np.ceil(percentile * n)) - 1)
        chosen = np.partition(diff, at, axis=1)[:, at]
        widths = np.array([int(c).bit_length() for c in chosen])
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            own = diff[rows]
            over = own >> np.uint32(width) if width < 32 else np.zeros_like(own)
            body = _pack(own & np.uint32((1 << int(width)) - 1), int(width))
            for k, r in enumerate(rows):
                where = np.flatnonzero(over[k])
                blocks[first + r] = b"".join((_BLOCK.pack(int(low[r]), int(width), len(where)), body[k].tobytes(), where.astype("<u2").tobytes(), own[k, where].astype("<u4").tobytes()))
    return blocks


def decode_blocks(data: bytes, starts: np.ndarray, ids: int, block_ids: int = BLOCK_IDS) -> np.ndarray:
    """The ids of all blocks; blocks of one width are unpacked together."""
    out = np.empty(ids, np.uint32)
    raw, same = np.frombuffer(data, np.uint8), {}
    for b, s in enumerate(starts.tolist()):
        low, width, n_over = _BLOCK.unpack_from(data, s)
        same.setdefault((width, min(block_ids, ids - b * block_ids)), []).append((b, s + _BLOCK.size, low, n_over))
    for (width, n), found in same.items():
        size = -(-width * n // 8)
        body = np.stack([raw[s : s + size] for _, s, _, _ in found])
        got = _unpack(body, width, n)
        for k, (b, s, low, n_over) in enumerate(found):
            if n_over:
                at = np.frombuffer(data, "<u2", n_over, s + size)
                got[k, at] = np.frombuffer(data, "<u4", n_over, s + size + 2 * n_over)
            out[b * block_ids : b * block_ids + n] = got[k] + np.uint32(low)
    return out


def encode_shard(doc_ids: list[int | None], ids: list[bytes], block_ids: int = BLOCK_IDS) -> bytes:
    """A whole file: each document's ids are little-endian unsigned 32-bit bytes. Documents without a doc_id come first."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    blocks = encode_blocks(flat, block_ids)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    index = np.empty((len(doc_ids), 2), "<i8")
    index[:, 0], index[:, 1] = [d or 0 for d in doc_ids], [len(x) // 4 for x in ids]
    size = len(MAGIC) + _HEAD.size + index.nbytes + 8 * len(blocks) + int(starts[-1])
    body = b"".join((index.tobytes(), starts[:-1].tobytes(), *blocks))
    return b"".join((MAGIC, _HEAD.pack(len(doc_ids), len(flat), len(blocks), block_ids, int(starts[-1]), size, doc_ids.count(None), zlib.crc32(body)), body))


def decode_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """doc_ids, counts, the ids of all documents one after another, and how many of the first documents have no doc_id."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a shard file")
    docs, ids, blocks, block_ids, _, size, unnamed, crc = _HEAD.unpack_from(data, len(MAGIC))
    if len(data) < size:
        raise ValueError("the shard file is cut short")
    at = len(MAGIC) + _HEAD.size
    if zlib.crc32(memoryview(data)[at:size]) != crc:
        raise ValueError("the shard file is damaged")
    index = np.frombuffer(data, "<i8", 2 * docs, at).reshape(-1, 2)
    at += index.nbytes
    starts = np.frombuffer(data, "<u8", blocks, at)
    return index[:, 0], index[:, 1], decode_blocks(data[at + 8 * blocks : size], starts, ids, block_ids), unnamed


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = tokens.END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of every whole text in ascending doc_id order as shard files under path.

    Equal doc_ids go by their text, and their first characters deal them, so that rows of one id or none aren't
    one task. A null text is empty; a null doc_id comes first."""
    vocabulary = tokenizer or tokens.default_path()
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    parts = portions(docs, F.length(text_of(text_col)) + 1, PART_CHARS)
    ordered = own.repartitionByRange(parts, "doc_id", F.substring("text", 1, DEALT)).sortWithinPartitions("doc_id", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ids, found, total = tokens.WordEncoder.of(vocabulary), [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([encode_shard(ids, found)], pa.binary())], names=["shard"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = encoder.encode(text, end_id)
                if ids and total + len(got) // 4 > shard_ids:
                    yield flush()
                    ids, found, total = [], [], 0
                ids.append(doc_id), found.append(got)
                total += len(got) // 4
        if ids:
            yield flush()

    (ordered.mapInArrow(shards, "shard binary").select(F.col("shard").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).option("compression", "none").text(path))


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 and, if asked for, ids. Each file is decoded once into a table of a few numbers a document; starts come from the
    totals of the shards before, one row a shard."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, counts, ids, unnamed = decode_shard(data.as_py())
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                pos = np.arange(len(doc_ids))
                cols = [pa.array([name] * len(doc_ids)), pa.array(pos), pa.array(doc_ids, mask=pos < unnamed), pa.array(ends - counts), pa.array(counts), pa.array(sums, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "pos", "doc_id", "own_start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    rows = written(files.mapInArrow(decoded, "shard string, pos long, doc_id long, own_start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids), "decoded")
    # within a run of equal ids the writer's file order holds
    place = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("ids"), F.min(place).alias("first"), F.max(place).alias("last"))
    # one row a shard of 2 million ids
    starts = totals.select("shard", F.coalesce(F.sum("ids").over(Window.orderBy("first", "last", "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(starts.hint("shuffle_hash"), "shard").select("doc_id", (F.col("before") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op10_patched_frame_of_reference(spark, sf_dir: str) -> DataFrame:
    """Writes and reads the files; an empty table writes none and gives no row."""
    path = shared_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path)
