"""Memory-counter CSV: two header rows, then Date, Time and padded MB/s readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortweave.functions.metrics import clean_double, millisecond_label


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """(ts, label, read_gb, write_gb, total_gb) of a counter log; unreadable numbers give null.

    Columns are found by both header rows, so their order is free. The header rows of each file are
    those whose first field isn't a date.
    """
    lines = spark.read.text(path)
    heads = [x[0].split(",") for x in lines.limit(2).collect()]
    names = [f"{a.strip()}.{b.strip()}".strip(".") for a, b in zip(*heads, strict=True)]
    last = ""
    for i, (a, b) in enumerate(zip(*heads, strict=True)):
        last = a.strip() or last  # a group's name stands over its first column only
        names[i] = f"{last}.{b.strip()}".strip(".")
    at = {n.split(".")[-1]: i for i, n in enumerate(names) if n.split(".")[-1] in ("Date", "Time")}
    at |= {k: names.index(f"System.{k}") for k in ("Read", "Write")}
    field = {k: F.split("value", ",")[i] for k, i in at.items()}
    rows = lines.where(F.col("value").rlike(r"^\s*\d{4}-\d\d-\d\d|,\s*\d{4}-\d\d-\d\d"))
    out = rows.select(
        F.to_timestamp(F.concat_ws(" ", F.trim(field["Date"]), F.trim(field["Time"]))).alias("ts"),
        (clean_double(field["Read"]) / 1024).alias("read_gb"),
        (clean_double(field["Write"]) / 1024).alias("write_gb"),
    )
    return out.withColumn("total_gb", F.col("read_gb") + F.col("write_gb")).withColumn("label", millisecond_label(F.col("ts")))
