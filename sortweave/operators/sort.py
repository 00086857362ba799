"""Global sort, argsort, take and global positions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortweave.functions.keys import sort_key
from sortweave.storage import keep

#: monotonically_increasing_id() has the partition above so many bits, and the row in its partition below.
ROW_BITS = 33


def sort_records(df: DataFrame, order: str = "O1", ties: Sequence[str] = ()) -> DataFrame:
    """Records sorted by key in the given order, each value staying with its key.

    Nothing is promised about equal keys unless ``ties`` names further columns. Null keys come first.
    One range exchange and one sort; Spark spills as needed.
    """
    return df.orderBy(sort_key(F.col("key"), order), *ties)


def sort_struct(df: DataFrame) -> DataFrame:
    """Rows of one struct column by that struct's first field, nulls last."""
    name = df.columns[0]
    key = df.schema[0].dataType.fieldNames()[0]
    return df.orderBy(F.col(name)[key].asc_nulls_last())


def sort_parts(df: DataFrame, parts: int, *by: str | Column) -> DataFrame:
    """``parts`` partitions of ascending ranges, each sorted: written out, the files are in order."""
    return df.repartitionByRange(parts, *by).sortWithinPartitions(*by)


def single_file(df: DataFrame, *by: str | Column) -> DataFrame:
    """One sorted partition, which is written as one file: for outputs that one task can write."""
    return df.coalesce(1).sortWithinPartitions(*by)


def ranged(df: DataFrame, by: Sequence[Column], parts: int | None = None) -> DataFrame:
    """Partitions of ascending ranges of ``by``, each sorted. Rows that are equal in ``by`` may be split: their number decides last."""
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    order = [*by, F.col("_tie")]
    dealt = tied.repartitionByRange(parts, *order) if parts else tied.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).drop("_tie")


def _first_of_key(batches):
    """Adds to rows in order of _k the place in this partition of the first row of the same key."""
    last, first, at = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(b.schema.get_field_index("_k"))
        if keys.type == pa.null():
            new = np.zeros(b.num_rows, bool)
        else:
            joined = pa.concat_arrays([pa.array([None if last is None else last.as_py()], keys.type), keys])
            x, y = joined.slice(0, b.num_rows), joined.slice(1)
            unlike = pc.fill_null(pc.not_equal(x, y), False)
            if pa.types.is_floating(keys.type):
                unlike = pc.and_not(unlike, pc.fill_null(pc.and_(pc.is_nan(x), pc.is_nan(y)), False))
            new = pc.or_(unlike, pc.xor(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False).copy()
        if not at:
            new[0] = True
        starts = np.where(new, np.arange(at, at + b.num_rows), -1)
        starts[0] = max(starts[0], first)
        starts = np.maximum.accumulate(starts)
        last, first, at = keys[-1], int(starts[-1]), at + b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts)], [*b.schema.names, "_first"])


def with_position(
    df: DataFrame, key: Column, ties: Sequence[Column] = (), nulls_last: bool = False, parts: int | None = None, name: str = "pos", ranked: bool = False
) -> DataFrame:
    """Adds the 1-based BIGINT position of each row in the global order of (key, ties).

    Rows are dealt out by ranges of (key, ties, a number of the row), sorted and numbered in their range, and kept in the
    shared folder, so the input is read twice: once for the ranges' sample. Each range is then shifted by the rows of those before it, a
    broadcast of at most ``parts`` rows (spark.sql.shuffle.partitions by default). A key that holds most rows spans as many
    ranges as it needs. Rows that tie in all are numbered once, in any order. ``ranked`` gives rank() of the
    key instead: equal keys, of an atomic type, share the position of the first, over as many ranges as they span.
    """
    k = F.col("_k")
    keyed = ranged(df.withColumn("_k", key), [k.asc_nulls_last() if nulls_last else k.asc_nulls_first(), *ties], parts)
    if ranked:
        keyed = keyed.mapInArrow(_first_of_key, T.StructType([*keyed.schema.fields, T.StructField("_first", T.LongType())]))
    else:
        keyed = keyed.drop("_k")
    kept = keep(keyed.withColumn("_id", F.monotonically_increasing_id()), "positions")
    kept = kept.withColumn("_range", F.shiftright("_id", ROW_BITS)).withColumn("_in", F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    order = Window.orderBy("_range")
    before = F.coalesce(F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if not ranked:
        counts = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select("_range", before.alias("_before"))
        at = F.col("_in") + F.col("_before") + 1
    else:
        ends = kept.groupBy("_range").agg(
            F.count(F.lit(1)).alias("_rows"), F.min_by(F.struct("_k"), "_in").alias("_lo"), F.max_by(F.struct("_k"), "_in").alias("_hi"), F.max("_first").alias("_last")
        ).withColumn("_before", before)
        opens = ~F.col("_lo").eqNullSafe(F.lag("_hi").over(order))
        began = F.when(F.col("_last") > 0, F.col("_before") + F.col("_last")).when(F.col("_opens"), F.col("_before"))
        earlier = F.max("_began").over(order.rowsBetween(Window.unboundedPreceding, -1))
        ends = ends.withColumn("_opens", opens).withColumn("_began", began)
        counts = ends.select("_range", "_before", F.when(F.col("_opens"), F.col("_before")).otherwise(earlier).alias("_start"))
        at = F.when(F.col("_first") == 0, F.col("_start")).otherwise(F.col("_before") + F.col("_first")) + 1
    placed = kept.join(F.broadcast(counts), "_range").withColumn(name, at.cast("bigint"))
    return placed.drop("_range", "_id", "_in", "_k", "_first", "_before", "_start")


def argsort(df: DataFrame, key: Column, index: str, ties: Sequence[Column] = ()) -> DataFrame:
    """(pos, index): the row index that comes at each position; ascending, nulls last."""
    return with_position(df.select(key.alias("_key"), index), F.col("_key"), ties or [F.col(index)], nulls_last=True).select("pos", index)


def take(df: DataFrame, indices: DataFrame, index: str) -> DataFrame:
    """Rows of ``df`` in the places that ``indices`` (pos, index) gives them."""
    return indices.join(df, index)


def top_k(df: DataFrame, k: int, *by: Column) -> DataFrame:
    """The first k rows of the order, with their positions. At most k rows meet in one task."""
    first = df.orderBy(*by).limit(k)
    return first.withColumn("pos", F.row_number().over(Window.orderBy(*by)).cast("bigint"))
