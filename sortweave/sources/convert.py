"""Fixed-width files to Parquet."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sortweave.functions.records import unsigned_records
from sortweave.sources import fixedkv


def to_parquet(spark: SparkSession, source: str | list[str], target: str, value_bytes: int = 8, order: str = "O4", single: bool = False) -> None:
    """Writes records of 8 key bytes as one struct column ``record`` (key, value). ``single``: as one file, by one task."""
    fixedkv.register(spark)
    records = unsigned_records(spark.read.format("fixedkv").options(keyBytes="8", valueBytes=str(value_bytes)).load(source), order)
    (records.coalesce(1) if single else records).write.parquet(target)
