"""What the operators share: global running totals and small helpers, beside the tables of sortweave.storage."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortweave.storage import keep, new_path, recorded, release, shared_dir

__all__ = ["WORD", "ascii_crc_bucket", "columns_free_of", "keep", "lean", "new_path", "numbered", "place_of", "plus", "recorded", "release", "running_total", "shared_dir", "utf8"]

#: What counts as white space between words, in all contracts: ASCII blank, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"

Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function for mapInArrow whose worker gives memory it no longer uses back to the system when a task ends.

    Workers are used again and wait idle beside others; what Arrow and the C library keep for later use is
    several times what such a worker needs.
    """

    @wraps(run)
    def inner(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
            if trim is not None:
                trim(0)

    return inner


def columns_free_of(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Only the wanted columns, whatever others there are: one of just that name, or else the first that differs in case only."""
    names = df.columns
    lower = [n.lower() for n in names]
    at = [names.index(w) if w in names else lower.index(w.lower()) for w in wanted]
    placed = df.toDF(*(f"c{i}" for i in range(len(names))))
    return placed.select(*(F.col(f"c{i}").alias(w) for i, w in zip(at, wanted, strict=True)))


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """A kept table of all columns, named by place, with _row, a number of each row; and their names."""
    names = docs.columns
    return keep(docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("_row", F.monotonically_increasing_id()), name), names


def place_of(names: Sequence[str], wanted: str) -> Column:
    """A column of a numbered table by its former name."""
    return F.col(f"c{names.index(wanted) if wanted in names else [n.lower() for n in names].index(wanted.lower())}")


def plus(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """The schema of ``df`` with further (name, type) fields."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in fields)])


def running_total(df: DataFrame, order: Sequence[Column], size: str, out: str, name: str) -> DataFrame:
    """Adds ``out`` BIGINT: the sum of ``size`` over all rows before this one in the global ``order``.

    The rows are dealt out by ranges of the order and sorted, each task adds up its own range while it
    streams, the result is kept, and each range is shifted by the sum of those before. Only one row for
    each range (at most spark.sql.shuffle.partitions rows) meets in one task and is broadcast. Ties in
    the order are placed as the sort left them, once.
    """
    schema = plus(df, ("_sum", "bigint"), ("_part", "int"))

    def add(batches):
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            sizes = b.column(b.schema.get_field_index(size)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes) + total
            arrays = [*b.columns, pa.array(ends - sizes), pa.array(np.full(b.num_rows, part, np.int32))]
            total = int(ends[-1])
            yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names, "_sum", "_part"])

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = keep(ranged.mapInArrow(add, schema), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = kept.groupBy("_part").agg(F.sum(size).alias("_size"))
    parts = parts.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return kept.join(F.broadcast(parts), "_part").withColumn(out, F.col("_sum") + F.col("_before")).drop("_sum", "_before", "_part")


def ascii_crc_bucket(column: Column, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo ``modulus``: how held-out documents are told. Null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


_SURROGATE = re.compile("[\ud800-\udfff]")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
