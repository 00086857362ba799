"""Seeded fixed-width records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortweave.functions.sizes import parse_size, record_counts


def _bytes(seed: int, what: str, length: int) -> Column:
    """``length`` uniform bytes that depend on the row id and the seed alone."""
    blocks = [F.sha2(F.concat_ws(":", F.lit(seed), F.lit(what), F.lit(i), F.col("id")), 256) for i in range((length + 31) // 32)]
    return F.substring(F.unhex(F.concat(*blocks)), 1, length) if blocks else F.unhex(F.lit(""))


def generate(spark: SparkSession, records: int, key_bytes: int = 8, value_bytes: int = 8, seed: int = 0, high_bit: bool = False) -> DataFrame:
    """Uniform random records; the first bit of each key is clear unless ``high_bit``.

    The same arguments give the same records at any partitioning and after any retry."""
    key = _bytes(seed, "k", key_bytes)
    if not high_bit:
        first = F.conv(F.hex(F.substring(key, 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(0x7F))
        key = F.concat(F.unhex(F.lpad(F.hex(first), 2, "0")), F.substring(key, 2, key_bytes))
    return spark.range(records).select(key.alias("key"), _bytes(seed, "v", value_bytes).alias("value"))


def generate_size(spark: SparkSession, total: str, key_bytes: int = 8, value_bytes: int = 8, seed: int = 0) -> tuple[DataFrame, int]:
    """As many records as ``total`` ("100M") holds, and the bytes left over."""
    rows, over = record_counts(parse_size(total), key_bytes, value_bytes)
    return generate(spark, rows, key_bytes, value_bytes, seed), over
