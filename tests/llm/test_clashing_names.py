from sortweave.llm import curriculum, hilbert_pack, imatch, kmeans_dedup, language_id, lattice_lm, license_scan, orc_ids, simhash
from sortweave.llm.common import new_path

EXTRA = "_row string, TEXT string, c0 string, row_id string, bucket string, size string"


def test_extra_columns(spark):
    rows = [(i, f"some words here {i % 3} and there", "en", f"s{i % 2}", 5, *["x"] * 6) for i in range(12)] + [(None, None, None, None, None, *[None] * 6)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")
    n = len(rows)
    assert hilbert_pack.pack(df).agg({"length": "sum"}).first()[0] > 0
    assert imatch.fingerprints(df).count() == n
    assert license_scan.scan(df).count() == n
    assert lattice_lm.score(df.withColumn("held_out", df.doc_id == 3)).count() == n
    assert simhash.near_duplicates(df).count() == n
    assert language_id.predict(df, language_id.fit(df)).count() == n
    assert curriculum.plan(df).count() == n
    path = new_path(spark, "clash")
    orc_ids.write_orc(df, path)
    assert orc_ids.read_orc(spark, path).count() == n
    for out in (simhash.dedupe(df), curriculum.mix(df), language_id.keep_identified(df)):
        assert out.columns == df.columns
        assert {r[5] for r in out.collect()} <= {"x", None}
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1, "a", "b"), (2, [1.0, 0.0], 1, "a", "b")], "vec_id long, embedding array<float>, label int, v string, LABEL string")
    assert [r.n_links for r in kmeans_dedup.near_duplicates(vectors).collect()] == [1, 1]
