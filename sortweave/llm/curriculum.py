"""Mixing sources to target weights over a time-varying curriculum.

Each source has a weight and a schedule, how its share rises or falls during training. The integral of a schedule is
the source's cumulative demand; a document that begins at some point of its source's line of tokens is
due when the demand reaches that point, which inverting the integral gives. Sorting by that position
yields the training order. All of it is built-in SQL but for the streamed running total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sortweave.llm.common import WORD, columns_free_of, keep, numbered, place_of, running_total

WEIGHTS, BUDGET, MOST = (3, 1, 2), 1.5, 2.0
#: How far a source's share tilts: from 1 + tilt at the start to 1 - tilt at the end, or the other way, in turn.
TILTS = (0.5, -0.5)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, place, source_size, before, target) from (source, source_size).

    Sources take their weights by code point order, null last. The budget is shared by weight; a source
    stops at ``most`` times its size and the excess is shared again: that is one level for all, at
    which sum(min(cap, level * weight)) is the budget. One row for each source meets in one task.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = sizes.withColumn("place", (F.row_number().over(everything) - 1).cast("bigint"))
    placed = placed.withColumn("before", F.coalesce(F.sum("source_size").over(everything.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    upward = Window.orderBy("full_at", "place")
    whole = Window.partitionBy()
    levels = placed.withColumn("total", F.sum("source_size").over(whole))
    levels = levels.withColumn("capped", F.coalesce(F.sum("cap").over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    levels = levels.withColumn("sharing", F.sum("weight").over(upward.rowsBetween(0, Window.unboundedFollowing)))
    levels = levels.withColumn("level", (F.lit(budget) * F.col("total") - F.col("capped")) / F.col("sharing"))
    level = F.coalesce(F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "place", "level"))).over(whole)["level"], F.lit(0.0))
    levels = levels.withColumn("target", F.least(F.col("cap"), level * F.col("weight")))
    return levels.select("source", "place", "source_size", "before", "target")


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST, row: str | None = None) -> DataFrame:
    """One row for each of (doc_id, text, source): row_id, doc_id, source, place, size, source_size, target, at, passes, part, taken.

    ``passes`` whole passes and the first ``part`` words of a further one are taken, ``taken`` words in all. The
    partial pass goes through a source in the order of md5(doc_id) and stops at the rounded target, so one
    document of each source may be cut, and a source takes exactly its rounded target. Null texts have size 0; null sources are
    one source; null ids count as empty text; equal (id, size) rows are interchangeable; an empty table gives none.
    A source's documents are ranges of one global order, so a large source is many tasks.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = columns_free_of(docs, ["doc_id", "text", "source", *([row] if row else [])])
    light = rows.select(number.alias("row_id"), F.col("doc_id").cast("bigint").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    light = keep(light, "mix-sizes")
    goals = keep(targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most), "mix-targets")
    joined = light.join(goals, light["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    joined = joined.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    placed = running_total(joined, [F.col(c) for c in ("place", "h", "size", "row_id")], "size", "along", "mix-places")
    placed = placed.withColumn("at", F.col("along") - F.col("before"))
    wanted = F.floor(F.col("target") + F.lit(0.5)).cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = wanted - F.col("passes") * F.col("source_size")
    placed = placed.withColumn("passes", passes)
    placed = placed.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("at"))).cast("bigint"))
    placed = placed.withColumn("taken", F.col("passes") * F.col("size") + F.col("part"))
    return placed.select("row_id", "doc_id", "source", "place", "size", "source_size", "target", "at", "passes", "part", "taken")


def due(demand: Column, tilt: Column) -> Column:
    """When a share of the source's demand is reached: inverts t + tilt * (t - t*t), the integral of 1 + tilt * (1 - 2t)."""
    rise = 1 + tilt
    return 2 * demand / (rise + F.sqrt(F.greatest(F.lit(0.0), rise * rise - 4 * tilt * demand)))


def occurrences(planned: DataFrame, tilts: Sequence[float] = TILTS) -> DataFrame:
    """(row_id, turn, words, size, position): each time a document is taken, and its place in training from 0 to 1."""
    turns = F.sequence(F.lit(0).cast("bigint"), F.col("passes"))
    rows = planned.where("taken > 0").withColumn("turn", F.explode(turns)).withColumn("words", F.when(F.col("turn") < F.col("passes"), F.col("size")).otherwise(F.col("part"))).where("words > 0")
    tilt = F.element_at(F.array(*map(F.lit, tilts)), (F.col("place") % len(tilts) + 1).cast("int"))
    middle = (F.col("turn") * F.col("source_size") + F.col("at") + F.col("words") / 2) / F.col("target")
    return rows.select("row_id", "turn", "words", "size", due(middle, tilt).alias("position"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST, tilts: Sequence[float] = TILTS) -> DataFrame:
    """The training order: rows of ``docs``, repeated as planned and range-sorted by position, a cut text where a source's target ends in it.

    Takes and returns all columns of ``docs``. Blank documents take no words and are left out.
    """
    whole, names = numbered(docs, "mix-docs")
    wanted = whole.select("_row", *(place_of(names, c).alias(c) for c in ("doc_id", "text", "source")))
    turns = occurrences(plan(wanted, weights, budget, most, row="_row"), tilts)
    renamed = turns.withColumnsRenamed({"row_id": "_row", "turn": "_turn", "words": "_words", "size": "_size", "position": "_position"})
    taken = whole.join(renamed.hint("shuffle_hash"), "_row")
    ordered = taken.repartitionByRange("_position", "_row", "_turn").sortWithinPartitions("_position", "_row", "_turn")
    # the words of a cut document, found by the end of its last one; all other texts stay as they are
    text = place_of(names, "text")
    stretches = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.when(F.col("_words") < F.col("_size"), F.array_join(F.slice(stretches, 1, F.col("_words").cast("int")), "")).otherwise(text)
    at = names.index("text") if "text" in names else [n.lower() for n in names].index("text")
    return ordered.withColumn(f"c{at}", cut).select(*(f"c{i}" for i in range(len(names)))).toDF(*names)


def order(planned: DataFrame, tilts: Sequence[float] = TILTS) -> DataFrame:
    """(row_id, turn, words, size, position) of all occurrences in training order, by ranges of the position: a kept table."""
    by = ("position", "row_id", "turn")
    return keep(occurrences(planned, tilts).repartitionByRange(*by).sortWithinPartitions(*by), "mix-order")


def curriculum(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST, tilts: Sequence[float] = TILTS) -> DataFrame:
    """What the training order has of each row of (doc_id, text, source): doc_id, size, source_size, target, taken, turns, first_position, last_position.

    The order is dealt first: each occurrence gets its position by inverting its source's integrated schedule, and the occurrences are range-sorted.
    ``taken`` adds up the words of a document's occurrences, ``turns`` counts them, and the positions are those of the first and the last, null for
    a document that has none. Nulls, ties, repeated rows and empty tables: as in ``plan``.
    """
    planned = keep(plan(docs, weights, budget, most), "mix-plan")
    found = order(planned, tilts).groupBy("row_id").agg(
        F.sum("words").alias("dealt"), F.count(F.lit(1)).alias("seen"), F.min("position").alias("first_position"), F.max("position").alias("last_position")
    )
    taken, turns = (F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for c, n in (("dealt", "taken"), ("seen", "turns")))
    return planned.join(found, "row_id", "left").select("doc_id", "size", "source_size", "target", taken, turns, "first_position", "last_position")


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the training order: words and positions of their occurrences."""
    return curriculum(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM p),
f AS (SELECT *, cap / weight AS full_at FROM w),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ()) - coalesce(sum(cap) OVER (ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) / (sum(weight) OVER (ORDER BY full_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM f),
t AS (SELECT *, least(cap, coalesce((SELECT level FROM l WHERE level <= full_at ORDER BY full_at, place LIMIT 1), 0.0::DOUBLE) * weight) AS target FROM l),
g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS wanted, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS passes FROM t),
c AS (SELECT d.doc_id, d.size, g.place, g.source_size, g.target, g.passes, g.wanted, sum(d.size) OVER (PARTITION BY g.place ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS along FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
o AS (SELECT *, greatest(0, least(size, wanted - passes * source_size - along))::BIGINT AS part FROM c),
t0 AS (SELECT *, unnest(range(passes + 1)) AS turn FROM o),
t1 AS (SELECT *, CASE WHEN turn < passes THEN size ELSE part END AS words, CASE place % 2 WHEN 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS tilt FROM t0),
t2 AS (SELECT doc_id, words, tilt, ((turn * source_size + along)::DOUBLE + words::DOUBLE / 2) / target AS demand FROM t1 WHERE words > 0),
t3 AS (SELECT doc_id, words, 2 * demand / ((1 + tilt) + sqrt(greatest(0.0::DOUBLE, (1 + tilt) * (1 + tilt) - 4 * tilt * demand))) AS position FROM t2),
x AS (SELECT doc_id, sum(words)::BIGINT AS taken, count(*) AS turns, min(position) AS first_position, max(position) AS last_position FROM t3 GROUP BY doc_id)
SELECT o.doc_id, o.size, o.source_size, o.target, coalesce(x.taken, 0)::BIGINT AS taken, coalesce(x.turns, 0)::BIGINT AS turns, x.first_position, x.last_position FROM o LEFT JOIN x ON o.doc_id = x.doc_id"""
