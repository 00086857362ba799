"""Token ids in ORC: one row a document, integer run-length encoding, row indexes and Bloom filters on document ids.

The files are written by ranges of doc_id in ascending order, so a reader that asks for some ids skips
files and stripes by their minimum and maximum, and row groups by their Bloom filters; every stripe can be
read by a task of its own. Ids are stored as ``array<int>``, whose values ORC packs by run-length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortweave.llm.common import columns_free_of, keep, lean, new_path, running_total
from sortweave.llm.tokens import encoder, vocabulary

SCHEMA = "row_id bigint, doc_id bigint, ids array<int>"


def _encode(vocab, end_id: int):
    def run(batches):
        """Streams sorted rows; ids of a few MB of text at a time."""
        row = TaskContext.get().partitionId() << 40
        enc = encoder(vocab.value)
        for b in batches:
            for part in enc.slices(b, 1):
                ids, offsets = enc.encode(part.column(1))
                ends = np.insert(ids.astype(np.int32), offsets[1:], end_id)
                lists = pa.ListArray.from_arrays((offsets + np.arange(len(offsets))).astype(np.int32), pa.array(ends, pa.int32()))
                rows = pa.array(np.arange(row, row + part.num_rows))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([rows, part.column(0), lists], ["row_id", "doc_id", "ids"])

    return run


def write_orc(docs: DataFrame, path: str, vocab: bytes | None = None, end_id: int = 0, stripe_bytes: int = 16 << 20, index_rows: int = 1000) -> None:
    """Writes ids of every whole text of (doc_id, text), each document ending in ``end_id``.

    Rows are dealt out by ranges of (doc_id, hash of the text): one shuffle of the texts, and a doc_id that
    repeats can be split. Null texts are empty and give the end id alone; null ids come first; further columns are left out.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocab or vocabulary())  # one vocabulary file: bounded
    rows = columns_free_of(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
    ranged = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    out = ranged.mapInArrow(lean(_encode(known, end_id)), SCHEMA).write
    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(index_rows), "orc.stripe.size": str(stripe_bytes)}
    out.options(**options).orc(path)


def read_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(row_id, doc_id, ids); with ``doc_ids``, a predicate that ORC applies to its statistics and Bloom filters."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def _digest(batches):
    for b in batches:
        ids = b.column(2)
        offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crcs = [zlib.crc32(values[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        lengths = np.diff(offsets).astype(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lengths), pa.array(crcs, pa.int64())], ["row_id", "doc_id", "n_tokens", "ids_crc32"])


def digests(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the stored rows, in file order."""
    # kept, as dealing rows out by ranges reads them twice
    light = keep(stored.mapInArrow(lean(_digest), "row_id bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint"), "orc-lengths")
    return running_total(light, [F.col("row_id")], "n_tokens", "start", "orc-digests").select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to ORC and read back."""
    path = new_path(spark, "orc-ids")
    write_orc(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return digests(read_orc(spark, path))
