"""Order statistics and exact splitters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_range(df: DataFrame, key: Column) -> DataFrame:
    return df.agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count(F.lit(1)).alias("n"))


def rank_count(df: DataFrame, key: Column, at: Column) -> DataFrame:
    """How many keys are at most ``at``."""
    return df.agg(F.count_if(key <= at).cast("bigint").alias("rank_count"))


#: Rows that a part is to have, about, and the deepest cut: the driver gets CELLS rows a part in each step.
PART_ROWS, DEEPEST = 1 << 25, 12


def parts_depth(rows: int, part_rows: int = PART_ROWS) -> int:
    """Levels of halving after which a part has about ``part_rows`` rows."""
    return min(DEEPEST, max(1, (max(1, rows) - 1) // part_rows).bit_length())


def exact_parts(df: DataFrame, key: Column, depth: int, name: str = "part") -> tuple[DataFrame, list[dict]]:
    """Cuts rows into at most 2**depth parts by repeated exact medians; equal keys stay together.

    At each level the splitter of a part of n rows is the key of rank max(1, floor(n/2)): keys up to it
    go left (2b), greater ones right (2b+1). Keys are BIGINT; null keys go to part 0 and count for no rank.

    Splitters are found for all parts of a level at once, by a search that cuts the interval of each
    part's keys into CELLS: every step is one aggregate over distinct keys with their counts, of which CELLS rows
    a part reach the driver (CELLS * 2**depth at most), and 11 steps at most narrow any BIGINT interval to a key.
    No step sorts or gathers a part in one task. Returns the rows with ``name`` and the splitters found.
    """
    counts = df.select(key.cast("bigint").alias("k")).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.persist()
    try:
        found: list[dict] = []
        bucket = F.lit(0)
        for level in range(depth):
            level_cuts = _medians(counts.withColumn("b", bucket))
            found += [{"level": level, "bucket": b, "splitter": v, "rows": n} for b, (v, n) in sorted(level_cuts.items())]
            bucket = _go(F.col("k"), bucket, {b: v for b, (v, _) in level_cuts.items()})
    finally:
        counts.unpersist()
    at = F.lit(0)
    for level in range(depth):
        at = _go(key.cast("bigint"), at, {x["bucket"]: x["splitter"] for x in found if x["level"] == level})
    return df.withColumn(name, F.coalesce(at, F.lit(0)).cast("bigint")), found


def _go(key: Column, bucket: Column, cuts: dict[int, int]) -> Column:
    """2b or 2b+1 by the cut of b."""
    cut = F.lit(None).cast("bigint")
    for b, v in cuts.items():
        cut = F.when(bucket == b, F.lit(v)).otherwise(cut)
    return 2 * bucket + F.coalesce((key > cut).cast("int"), F.lit(0))


#: Into how many equal intervals a step of the search cuts each part's span of keys.
CELLS = 64


def _medians(dealt: DataFrame) -> dict[int, tuple[int, int]]:
    """bucket -> (splitter, rows) for (b, k, c)."""
    found = dealt.groupBy("b").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum("c").alias("n")).collect()
    rows = {r["b"]: r["n"] for r in found}
    spans = {r["b"]: (r["lo"], r["hi"], max(1, r["n"] // 2)) for r in found}  # where the key of the wanted rank lies
    while open_ := {b: s for b, s in spans.items() if s[0] < s[1]}:
        cell = F.lit(None).cast("int")
        for b, (lo, hi, _) in open_.items():
            step = -(-(hi - lo + 1) // CELLS)
            offset = F.col("k").cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")
            inside = (F.col("b") == b) & F.col("k").between(lo, hi)
            cell = F.when(inside, F.floor(offset / F.lit(step).cast("decimal(20,0)")).cast("int")).otherwise(cell)
        got = dealt.withColumn("cell", cell).where("cell is not null").groupBy("b", "cell").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum("c").alias("n"))
        wanted = {b: s[2] for b, s in open_.items()}
        for r in sorted(got.collect(), key=lambda r: (r["b"], r["lo"])):
            if 0 < wanted[r["b"]] <= r["n"]:
                spans[r["b"]] = (r["lo"], r["hi"], wanted[r["b"]])
            wanted[r["b"]] -= r["n"]
    return {b: (s[0], rows[b]) for b, s in spans.items()}
