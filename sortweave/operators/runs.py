"""Sorted runs: key/index projection, run assignment, and gathering values by index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_index_pairs(df: DataFrame, key: Column, index: str) -> DataFrame:
    """(key, row_idx): what a sort moves when values stay behind."""
    return df.select(key.alias("key"), F.col(index).cast("bigint").alias("row_idx"))


def value_gather(pairs: DataFrame, values: DataFrame, index: str = "row_idx") -> DataFrame:
    """Brings values back to (key, index) pairs.

    Worth its join only for values much wider than their keys: Spark's sort already moves
    pointers, and a sort of whole rows shuffles each row once, not twice.
    """
    return pairs.join(values, index)


def assign_runs(df: DataFrame, index: str, run_rows: int) -> DataFrame:
    """Adds run_id: rows ``run_rows * i`` up to the next multiple are run i."""
    return df.withColumn("run_id", F.floor(F.col(index) / F.lit(run_rows)).cast("bigint"))


def sort_runs(df: DataFrame, key: Column, ties: Sequence[Column] = ()) -> DataFrame:
    """Adds the 1-based position of each row in its own run. Runs are as many tasks as there are runs."""
    inside = Window.partitionBy("run_id").orderBy(key, *ties)
    return df.withColumn("run_pos", F.row_number().over(inside).cast("bigint"))


def attach_run_values(merged: DataFrame, run_values: DataFrame) -> DataFrame:
    """Merged (key, run_id, run_pos) with the value that its run has at that place."""
    return merged.join(run_values, ["run_id", "run_pos"])
