import math
from collections import Counter

import corpus_pipeline
from sortweave.llm import curriculum
from sortweave.llm.common import keep


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = keep(stage(spark, docs, sf), name)
        counts.append(out.count())
        if name != "pack":
            assert out.schema.names == docs.schema.names
        docs = out
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert n * 0.98 <= counts[0] <= n
    assert counts[1] < counts[0]
    assert docs.agg({"length": "sum"}).first()[0] > 0


def test_mix_takes_what_is_planned(spark):
    rows = [(i, f" a{i} b\tc " * (i % 5), "s1" if i % 3 else None if i % 2 else "s0", "x") for i in range(60)] + [(None, None, "s1", "y"), (5, "a b c", "s1", "z"), (5, "a b c", "s1", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Place string")
    plan = curriculum.plan(df).collect()
    mixed = curriculum.mix(df).collect()
    got, want = Counter(), Counter()
    for r in mixed:
        got[r.doc_id] += len(r.text.split())
    for r in plan:
        want[r.doc_id] += r.taken
    assert got == Counter({k: v for k, v in want.items() if v})
    total = sum(r.size for r in plan)
    targets = {r.source: r.target for r in plan}
    assert math.isclose(sum(targets.values()), 1.5 * total)
    for s, t in targets.items():
        assert sum(r.taken for r in plan if r.source == s) == math.floor(t + 0.5)
    assert all(r.taken <= 2 * r.size for r in plan)
    assert curriculum.mix(df.limit(0)).count() == 0


def test_positions_invert_the_schedule(spark):
    from pyspark.sql import functions as F

    for tilt in (0.5, -0.5, 0.25):
        df = spark.range(101).select((F.col("id") / 100).alias("t")).withColumn("d", F.col("t") + tilt * (F.col("t") - F.col("t") * F.col("t")))
        assert all(abs(r.t - r.u) < 1e-9 for r in df.select("t", curriculum.due(F.col("d"), F.lit(tilt)).alias("u")).collect())


def test_run_on_nulls_repeated_and_no_rows(spark, tmp_path):
    """Copies and rejected texts go, nulls in any column crash nothing, and the pieces hold the ids of what is left."""
    english = "the cat sat on the mat and the dog lay by the door while it was raining in the town "
    rows = [(i, english * (1 + i % 3) + f"number{i} is here", "en", None if i % 4 == 0 else "s", None) for i in range(40)]
    rows += [(100, rows[7][1], "en", "s", 5), (7, rows[7][1], "en", "s", 5), (None, None, None, None, None), (101, None, "en", "s", 1), (102, "", None, "s", 1), (103, "12345 !!", "en", None, 1), (None, english * 4, "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    ids = {r.doc_id for r in pieces}
    assert len(pieces) > 20 and not ids & {100, 101, 102, 103}
    assert sum(r.length for r in pieces) == 2048 * max(r.sequence_id for r in pieces) + max(r.offset + r.length for r in pieces if r.sequence_id == max(x.sequence_id for x in pieces))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_stages_delete_what_the_one_before_kept(spark, sf):
    import os

    from sortweave import storage

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [p for stage_name in ("language", "near_duplicates") for p in corpus_pipeline._kept.get(stage_name, [])]
        docs = keep(stage(spark, docs, sf), name)
        if name == "source_mix":
            assert before and not any(os.path.exists(p.removeprefix("file://")) for p in before)
    assert docs.count() and storage._made
