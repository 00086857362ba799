"""Fixed-width record codec on BINARY columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortweave.functions.keys import flip_sign, long_of_key, sort_key, unsigned_decimal


def encode_record(key: Column, value: Column) -> Column:
    """``[key bytes][value bytes]``."""
    return F.concat(key, value)


def decode_key(record: Column, key_bytes: int) -> Column:
    return F.substring(record, 1, key_bytes)


def decode_value(record: Column, key_bytes: int, value_bytes: int) -> Column:
    return F.substring(record, key_bytes + 1, value_bytes)


def record_struct(df: DataFrame) -> DataFrame:
    """One column ``record`` of struct(key, value), as the Parquet layout has it."""
    return df.select(F.struct("key", "value").alias("record"))


def unsigned_records(df: DataFrame, order: str = "O4") -> DataFrame:
    """``record`` with the unsigned value of 8 key bytes, little-endian (O4) or big-endian (O5), as DECIMAL(20,0): what a Parquet UINT64 reads as."""
    stored = {"O4": lambda: flip_sign(sort_key(F.col("key"), "O4")), "O5": lambda: long_of_key(F.col("key"))}
    if order not in stored:
        raise ValueError(f"order must be O4 or O5, not {order!r}")
    return record_struct(df.select(unsigned_decimal(stored[order]()).alias("key"), "value"))


def record_fields(df: DataFrame) -> DataFrame:
    """key and value of the one struct column; any other schema is refused."""
    if len(df.columns) != 1 or df.schema[0].dataType.typeName() != "struct" or not df.schema[0].dataType.fields:
        raise ValueError("expected exactly one struct column")
    struct = df.schema[0]
    key, *rest = struct.dataType.fieldNames()
    return df.select(F.col(struct.name)[key].alias("key"), *(F.col(struct.name)[x].alias(x) for x in rest))
