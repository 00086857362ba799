"""Packing along a space-filling curve.

A document's token ids are hashed to a signed vector, which is projected to a few dimensions and placed on a
grid; documents are sorted by the Hilbert key of their cell and laid end to end in that order. The line
of tokens is cut every ``length`` ids, so neighbours on the curve share sequences and only the last one is not full.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortweave.llm.common import columns_free_of, keep, lean, running_total
from sortweave.llm.tokens import encoder, vocabulary

DIMENSIONS, BITS, FEATURES = 4, 10, 512


def projection(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((FEATURES, DIMENSIONS))


def hash_features(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature number and sign of each id, by multiplicative hashing."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(40)).astype(np.int64) % FEATURES, np.where(h >> np.uint64(63), 1.0, -1.0)


def token_table(vocab_size: int) -> np.ndarray:
    """What each id adds to a document's projected vector: the hashed vector is never built."""
    feature, sign = hash_features(np.arange(vocab_size))
    return projection()[feature] * sign[:, None]


def project(ids: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Projected vectors of documents, each scaled by the square root of its tokens. Documents without ids lie at the origin."""
    sums = np.zeros((len(offsets) - 1, DIMENSIONS))
    full = np.diff(offsets) > 0
    if full.any():
        for d in range(DIMENSIONS):
            sums[full, d] = np.add.reduceat(table[:, d][ids], offsets[:-1][full])
    return sums / np.sqrt(np.maximum(1, np.diff(offsets)))[:, None]


def grid(points: np.ndarray) -> np.ndarray:
    """Cells 0 .. 2**BITS - 1 in each dimension; a squashing function takes every real number."""
    return np.minimum((1 << BITS) - 1, ((1 + np.tanh(points / 8)) / 2 * (1 << BITS)).astype(np.int64))


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of grid cells: coordinates are turned into the transposed index bit by bit, then interleaved."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[:, i] & q) > 0
            swap = (x[:, 0] ^ x[:, i]) & low
            x[:, 0] ^= np.where(on, low, swap)
            if i:
                x[:, i] ^= np.where(on, 0, swap)
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[:, dims - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def _tokenise(vocab, end_id: int):
    def run(batches):
        enc = encoder(vocab.value)
        table = token_table(max(len(enc.bytes_of), end_id + 1))
        for b in batches:
            for part in enc.slices(b, 1):
                ids, offsets = enc.encode(part.column(1))
                keys = hilbert_keys(grid(project(ids, offsets, table)))
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
                width = enc.dtype.itemsize
                # 32-bit offsets: a slice of texts is at most a few hundred MB, and ids are shorter than texts
                data = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((offsets * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
                arrays = [part.column(0), part.column(2), pa.array(keys), pa.array(np.diff(offsets)), pa.array(np.full(part.num_rows, width, np.int32)), data]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row_id", "key", "doc_tokens", "width", "ids"])

    return run


def _cut(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("key", pa.int64())])

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, at, key, tokens, width, data in zip(*(b.column(i).to_pylist() for i in range(5)), b.column(5), strict=True):
                ids = np.frombuffer(data.as_buffer(), f"<u{width}").astype("<u4")
                begin = 0
                while begin < tokens:
                    sequence, offset = divmod(at + begin, length)
                    n = min(tokens - begin, length - offset)
                    rows.append((doc_id, begin, n, zlib.crc32(ids[begin : begin + n]), tokens, sequence, offset, key))
                    begin += n
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return run


def pack(docs: DataFrame, length: int = 2048, vocab: bytes | None = None, end_id: int = 1) -> DataFrame:
    """Packs every document of (doc_id, text) into sequences of ``length`` ids; one row for each piece.

    Returns doc_id, start (ids of the document before the piece), length, ids_crc32, doc_tokens, sequence_id,
    offset, hilbert_key. Sequences are full but for the last. Null texts are empty and hold the end id alone;
    documents with equal ids and repeated doc_ids are packed once for each row, in a fixed order; null doc_ids stay null;
    an empty table gives no piece; further columns are left out.

    Texts are encoded once and their ids kept in the shared folder; only keys and lengths are sorted along the curve.
    Positions then meet the ids by row in one shuffle. A document is a row in all of this: none is gathered with others.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocab or vocabulary())  # one vocabulary file: bounded
    rows = columns_free_of(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row_id"))
    ids = keep(rows.mapInArrow(lean(_tokenise(known, end_id)), "doc_id bigint, row_id bigint, key bigint, doc_tokens bigint, width int, ids binary"), "pack-ids")
    light = ids.select("row_id", "key", "doc_id", "doc_tokens")
    order = [F.col(c) for c in ("key", "doc_id", "doc_tokens", "row_id")]
    placed = running_total(light, order, "doc_tokens", "at", "pack-places").select("row_id", "at")
    whole = ids.join(placed.hint("shuffle_hash"), "row_id").select("doc_id", "at", "key", "doc_tokens", "width", "ids")
    out = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, hilbert_key bigint"
    return whole.mapInArrow(lean(_cut(length)), out)


def op1_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed to sequences of at most 2048 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
