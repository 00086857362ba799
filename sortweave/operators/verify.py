"""Checks of a sorted result: adjacent order, order across parts, and that it is a permutation of its input."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortweave.functions.keys import sort_key


def _adjacent(schema: pa.Schema):
    """One row for a sorted partition of (key, group): its rows, inversions inside, and what it begins and ends with."""

    def run(batches):
        n = bad = 0
        lo = hi = None
        for b in batches:
            if not b.num_rows:
                continue
            k, g = b.column(0), b.column(1)
            if hi is not None:
                k, g = (pa.concat_arrays([pa.array([x], c.type), c]) for x, c in zip(hi, (k, g), strict=True))
            else:
                lo = (k[0].as_py(), g[0].as_py())
            m = len(k) - 1
            falls, same = pc.less(k.slice(1), k.slice(0, m)), pc.equal(g.slice(1), g.slice(0, m))
            bad += int(np.count_nonzero(pc.fill_null(pc.and_(falls, same), False).to_numpy(zero_copy_only=False)))
            hi, n = (k[m].as_py(), g[m].as_py()), n + b.num_rows
        if n:
            values = (TaskContext.get().partitionId(), n, bad, *lo, *hi)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types, strict=True)], schema=schema)

    return run


def inversions(df: DataFrame, key: Column, pos: str, group: str | None = None) -> DataFrame:
    """One row with n and inversions: rows whose key is below that of the row before, in the order of ``pos``.

    Positions may have gaps. Rows of one position are taken in key order; a null key is below and above nothing. With ``group`` the order is
    (group, pos), and only neighbours in one group count. Rows are dealt out by ranges of the order and checked
    as they stream by; a row for each range then meets its neighbours. Keys must be of an atomic type.
    """
    at = df.select(key.alias("k"), (F.col(group) if group else F.lit(0)).alias("g"), F.col(pos).alias("p")).where("p is not null")
    by = ["g", "p", "k"]
    ordered = at.repartitionByRange(*by).sortWithinPartitions(*by).select("k", F.coalesce(F.col("g").cast("bigint"), F.lit(-1)).alias("g"))
    kind = ordered.schema["k"].dataType
    out = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("bad", T.LongType()), T.StructField("lo", kind), T.StructField("lo_g", T.LongType()), T.StructField("hi", kind), T.StructField("hi_g", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    ends = ordered.mapInArrow(_adjacent(to_arrow_schema(out)), out)
    order = Window.orderBy("part")
    seam = ((F.col("lo") < F.lag("hi").over(order)) & (F.col("lo_g") == F.lag("hi_g").over(order))).cast("bigint")
    seams = ends.withColumn("seam", F.coalesce(seam, F.lit(0)))
    return seams.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("bad") + F.col("seam")), F.lit(0)).alias("inversions"))


def boundaries(df: DataFrame, key: Column, part: str) -> DataFrame:
    """For each part its rows, least and greatest key, and whether it starts below the end of the part before.

    One row for each part reaches the window."""
    parts = df.groupBy(F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    return parts.withColumn("misplaced", F.coalesce((F.col("lo") < F.max("hi").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).cast("bigint"), F.lit(0)))


def row_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """A text that no other row has: each value as hex with its length before it; null, which has no length, as ``n``."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns:
        hexed = F.hex(c if kinds[c] == "binary" else F.encode(F.col(c).cast("string"), "UTF-8"))
        out.append(F.coalesce(F.concat(F.length(hexed).cast("string"), F.lit(":"), hexed), F.lit("n")))
    return F.concat(*out)


def multiset(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n, and two order-free sums of 64-bit halves of row digests, as texts: equal for permutations of the same rows."""
    digest = F.md5(row_text(df, columns).cast("binary"))
    halves = [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)") for i in range(2)]
    sums = [F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").cast("string") for h in halves]
    return df.agg(F.count(F.lit(1)).alias("n"), sums[0].alias("digest_a"), sums[1].alias("digest_b"))


def parts_sorted(df: DataFrame, key: Column, part: str, at: str) -> DataFrame:
    """all_sorted: whether every part is in order in itself, by (part, at). True for no rows."""
    return inversions(df, key, at, part).select((F.col("inversions") == 0).alias("all_sorted"))


@dataclass(frozen=True)
class Report:
    rows: int
    rows_expected: int
    inversions: int
    misplaced_parts: int
    permutation: bool

    @property
    def ok(self) -> bool:
        return self.permutation and self.rows == self.rows_expected and not self.inversions and not self.misplaced_parts


def report(result: DataFrame, source: DataFrame, order: str = "O1", part: str = "part", at: str = "row") -> DataFrame:
    """One row: rows, rows_expected, inversions inside parts, misplaced_parts, permutation, ok."""
    keyed = result.withColumn("_k", sort_key(F.col("key"), order))
    bad = inversions(keyed, F.col("_k"), at, part).select("inversions")
    misplaced = boundaries(keyed, F.col("_k"), part).agg(F.coalesce(F.sum("misplaced"), F.lit(0)).alias("misplaced_parts"))
    mine, theirs = (multiset(x, ["key", "value"]) for x in (result, source))
    theirs = theirs.toDF("rows_expected", "a", "b")
    one = mine.crossJoin(theirs).crossJoin(bad).crossJoin(misplaced)  # four tables of one row
    same = (F.col("n") == F.col("rows_expected")) & (F.col("digest_a") == F.col("a")) & (F.col("digest_b") == F.col("b"))
    one = one.select(F.col("n").alias("rows"), "rows_expected", "inversions", "misplaced_parts", same.alias("permutation"))
    return one.withColumn("ok", F.col("permutation") & (F.col("inversions") == 0) & (F.col("misplaced_parts") == 0))


def verify(result: DataFrame, source: DataFrame, order: str = "O1", part: str = "part", at: str = "row") -> Report:
    """Checks records (key, value) numbered by (part, row) against the source they were sorted from.

    ``fixedkv`` reads give both columns when asked for positions. Equal keys are in order."""
    found = report(result, source, order, part, at).first()
    return Report(found["rows"], found["rows_expected"], found["inversions"], found["misplaced_parts"], found["permutation"])
