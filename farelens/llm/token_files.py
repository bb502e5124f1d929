"""Operator 3: token-id output as patched frame-of-reference blocks.

A chunk holds whole documents: a header, the documents' ids and lengths, a
block index and blocks of 128 ids.  A block subtracts its minimum, packs the
rest at the width that holds at least 15/16 of its values, and lists the
others as exceptions (position, value); the index has each block's minimum,
width, exception count and start, so any block is read without the ones
before it.  Chunks are rows of a Parquet table with one binary column, in
ascending doc_id order (shard, then start), written through Spark so that a
lost executor's task is simply redone and any file system works.

Defined results: null text is empty (only the end id); rows with a null
doc_id come first; rows that share a doc_id are ordered by text.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._batches import slices, text_buffer
from ._store import documents, new_path, shuffle_width
from ._words import CALL_BYTES, encoder

BLOCK = 128
CHUNK_IDS = 1 << 18
MAGIC = b"PFR1"
_HEAD = struct.Struct("<4sIII")
_NO_ID = -(1 << 63)


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that hold the values of x."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _pack(v: np.ndarray, w: int) -> np.ndarray:
    """(blocks, 128) values below 2**w -> (blocks, 2w) 64-bit words."""
    cols = np.ascontiguousarray(v.T.astype(np.uint64))
    out = np.zeros((2 * w, len(v)), np.uint64)
    for j in range(BLOCK):
        word, bit = divmod(j * w, 64)
        out[word] |= cols[j] << np.uint64(bit)
        if bit + w > 64:
            out[word + 1] |= cols[j] >> np.uint64(64 - bit)
    return out.T


def _unpack(words: np.ndarray, w: int) -> np.ndarray:
    cols, mask = np.ascontiguousarray(words.T), np.uint64((1 << w) - 1)
    out = np.empty((BLOCK, len(words)), np.uint64)
    for j in range(BLOCK):
        word, bit = divmod(j * w, 64)
        out[j] = cols[word] >> np.uint64(bit)
        if bit + w > 64:
            out[j] |= cols[word + 1] << np.uint64(64 - bit)
    return out.T & mask


def write_chunk(doc_ids: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> bytes:
    """One chunk: documents with their ids, packed."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    v = np.empty(blocks * BLOCK, np.int64)
    v[:n] = ids
    v[n:] = ids[-1] if n else 0
    v = v.reshape(blocks, BLOCK)
    low = v.min(axis=1) if blocks else np.zeros(0, np.int64)
    rest = v - low[:, None]
    bits = _widths(rest)
    width = np.sort(bits, axis=1)[:, BLOCK * 15 // 16 - 1] if blocks else np.zeros(0, np.int64)
    out = bits > width[:, None]
    at_block, at = np.nonzero(out)
    values = rest[at_block, at].astype("<u4")
    rest[out] = 0
    start = np.zeros(blocks + 1, np.int64)
    np.cumsum(2 * width, out=start[1:])
    packed = np.zeros(start[-1], np.uint64)
    for w in np.unique(width):
        if w:
            k = np.flatnonzero(width == w)
            packed[start[k][:, None] + np.arange(2 * w)] = _pack(rest[k], int(w))
    parts = (
        np.asarray(doc_ids, "<i8"), np.asarray(lens, "<u4"), low.astype("<u4"), width.astype("u1"),
        out.sum(axis=1).astype("u1"), start[:-1].astype("<u4"), at.astype("u1"), values, packed.astype("<u8"),
    )
    return _HEAD.pack(MAGIC, len(doc_ids), n, blocks) + b"".join(p.tobytes() for p in parts)


def read_chunk(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, ids per document, ids) of a chunk."""
    magic, docs, n, blocks = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token chunk")
    pos = _HEAD.size

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal pos
        x = np.frombuffer(data, kind, k, pos)
        pos += x.nbytes
        return x

    doc_ids, lens, low, width = take("<i8", docs), take("<u4", docs), take("<u4", blocks), take("u1", blocks)
    patches, start = take("u1", blocks), take("<u4", blocks).astype(np.int64)
    count = int(patches.sum())
    at, values = take("u1", count), take("<u4", count)
    packed = take("<u8", int(2 * width.astype(np.int64).sum()))
    v = np.zeros((blocks, BLOCK), np.uint64)
    for w in np.unique(width):
        if w:
            k = np.flatnonzero(width == w)
            v[k] = _unpack(packed[start[k][:, None] + np.arange(2 * int(w))], int(w))
    v[np.repeat(np.arange(blocks), patches), at] = values
    v += low[:, None].astype(np.uint64)
    return doc_ids, lens, v.reshape(-1)[:n].astype("<u4")


_CHUNKS = "shard int, start long, n_ids long, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode ``docs`` (doc_id, text) and write the chunk table at ``path``."""
    schema = pa.schema([("shard", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, done = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal done, held
            lens, ids = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            payload = write_chunk(np.concatenate([h[0] for h in held]), lens, ids)
            row = pa.record_batch([[shard], [done], [len(ids)], [payload]], schema=schema)
            done, held = done + len(ids), []
            return row

        for b in batches:
            key = b.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            offsets, _ = text_buffer(b.column("text"))
            for i, j in slices(offsets, CALL_BYTES):
                flat, lens = enc.encode(b.column("text").slice(i, j - i).fill_null(""), end_id)
                upto = np.concatenate(([0], np.cumsum(lens)))
                for a, z in slices(upto, CHUNK_IDS // 4):
                    held.append((key[i + a : i + z], lens[a:z], flat[upto[a] : upto[z]]))
                    if sum(len(h[2]) for h in held) >= CHUNK_IDS:
                        yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = shuffle_width(docs.sparkSession)
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, _CHUNKS).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, payload in zip(b.column("base").to_pylist(), b.column("payload"), strict=True):
                doc_ids, lens, ids = read_chunk(payload.as_py())
                upto = np.zeros(len(lens) + 1, np.int64)
                np.cumsum(lens, out=upto[1:])
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                keys = pa.array(doc_ids, mask=doc_ids == _NO_ID)
                yield pa.record_batch([keys, base + upto[:-1], lens.astype(np.int64), pa.array(crc, pa.int64())], schema=schema)

    chunks = spark.read.schema(_CHUNKS).parquet(path)
    # One row a shard: the number of shards is the writer's partition count, so both the window and the broadcast are bounded.
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("shard", before.alias("before"))
    rows = chunks.join(F.broadcast(totals), "shard").select((F.col("before") + F.col("start")).alias("base"), "payload")
    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_tokens(spark, path)
