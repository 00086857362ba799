"""Order-preserving bag union of sorted inputs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortweave.operators.sort import with_position
from sortweave.operators.split import exact_parts, parts_depth


def merge_runs(runs: Sequence[DataFrame], *by: Column) -> DataFrame:
    """All rows of all runs, in order. Runs may be empty and of any lengths; nothing is dropped.

    Each range of keys is merged by one task: a range exchange, then Spark's sort, which merges spills.
    """
    if not runs:
        raise ValueError("no runs to merge")
    return reduce(DataFrame.unionByName, runs).orderBy(*by)


def merge_positions(runs: Sequence[DataFrame], key: Column, ties: Sequence[Column] = ()) -> DataFrame:
    """The merged rows with run_id and their global positions. Equal keys: the later run first, then ``ties``."""
    tagged = [r.withColumn("run_id", F.lit(i).cast("bigint")) for i, r in enumerate(runs)]
    return with_position(reduce(DataFrame.unionByName, tagged), key, [F.col("run_id").desc(), *ties])


def merge_by_parts(runs: Sequence[DataFrame], key: Column, ties: Sequence[Column] = (), depth: int | None = None) -> DataFrame:
    """The merged rows with part and part_pos: runs cut at shared exact splitters of a BIGINT key, each part numbered on its own.

    Without ``depth`` there are as many levels as the number of rows asks for. Parts are ascending ranges of the key, so one
    numbering of all rows gives the place in each part: no part is one task, however large it is.
    """
    together = reduce(DataFrame.unionByName, runs)
    parts, _ = exact_parts(together, key, parts_depth(together.count()) if depth is None else depth)
    placed = with_position(parts, F.col("part"), [key, *ties], name="_pos")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("_n")).select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(sizes), F.col("part") == F.col("_part")).withColumn("part_pos", F.col("_pos") - F.col("_before")).drop("_pos", "_part", "_before")
