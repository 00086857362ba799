import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sortweave.operators import merge, sort, split


@pytest.mark.parametrize("values", [[], [4], [7] * 900 + list(range(100)), [None] * 50 + [1, 1, 2], list(range(300)), [3] * 40], ids=["none", "one", "hot", "nulls", "all", "same"])
@pytest.mark.parametrize("nulls_last", [False, True])
def test_ranks_span_ranges(spark, values, nulls_last):
    random.Random(3).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "k long").repartition(3)
    got = sort.with_position(df, F.col("k"), nulls_last=nulls_last, ranked=True, parts=7)
    order = sorted(values, key=lambda v: ((v is None) == nulls_last, v or 0))
    assert Counter((r.k, r.pos) for r in got.collect()) == Counter((v, order.index(v) + 1) for v in values)


def test_ranks_of_texts_and_not_a_number(spark):
    df = spark.createDataFrame([("b", float("nan")), ("a", 1.0), ("b", float("nan")), (None, 2.0)], "t string, x double")
    assert sorted(r.pos for r in sort.with_position(df, F.col("t"), ranked=True, parts=2).collect()) == [1, 2, 3, 3]
    assert sorted(r.pos for r in sort.with_position(df, F.col("x"), ranked=True, parts=2).collect()) == [1, 2, 3, 3]


def test_one_key_is_dealt_evenly(spark):
    """A key with nine tenths of the rows spans ranges of like sizes."""
    df = spark.range(20000).select(F.when(F.col("id") % 10 > 0, 5).otherwise(F.col("id")).alias("k"), "id")
    parts = sort.ranged(df, [F.col("k")], 8).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 2 * 20000 / 8
    placed = sort.with_position(df, F.col("k"), [F.col("id")], parts=8).orderBy("pos").collect()
    assert [r.pos for r in placed] == list(range(1, 20001))
    assert [(r.k, r.id) for r in placed] == sorted((r.k, r.id) for r in placed)


def test_positions_are_fixed_for_unstable_input(spark):
    """Rows that a second evaluation would change are numbered once."""
    df = spark.range(500).withColumn("k", F.rand())
    placed = sort.with_position(df, F.col("k"))
    once, again = (sorted((r.pos, r.k) for r in placed.collect()) for _ in range(2))
    assert once == again and [k for _, k in once] == sorted(k for _, k in once)


def test_merge_by_parts_of_any_depth(spark):
    assert [split.parts_depth(n, 10) for n in (0, 10, 11, 20, 21, 40, 41)] == [1, 1, 1, 1, 2, 2, 3]
    data = [[5] * 30 + list(range(20)), [], [1, 9, 9]]
    frames = [spark.createDataFrame([(k,) for k in ks], "k long") for ks in data]
    for depth in (None, 1, 3):
        got = merge.merge_by_parts(frames, F.col("k"), depth=depth).orderBy("part", "part_pos").collect()
        assert [r.k for r in got] == sorted(sum(data, []))
        for p in {r.part for r in got}:
            assert [r.part_pos for r in got if r.part == p] == list(range(1, 1 + sum(r.part == p for r in got)))


def test_single_file(spark, tmp_path):
    sort.single_file(spark.range(100).repartition(5), F.col("id").desc()).write.csv(str(tmp_path / "one"))
    (file,) = (tmp_path / "one").glob("part-*")
    assert file.read_text().split() == [str(i) for i in range(99, -1, -1)]
