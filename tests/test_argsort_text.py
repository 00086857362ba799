from sortweave.plans.queries import QUERIES


def test_no_document_is_dropped(spark, tmp_path):
    rows = [(1, "éa"), (2, None), (3, "b"), (4, "ab"), (5, "aa"), (6, ""), (7, "漢"), (8, "aa"), (9, "\U0001f600"), (10, "～"), (11, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.doc_id for r in QUERIES["argsort_text"](spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [i for i, t in sorted(rows, key=lambda r: (r[1] is None, (r[1] or "").encode(), r[0]))]


def test_first_bytes_of_all_documents(spark, tmp_path):
    rows = [(1, "éa"), (2, None), (3, "b"), (4, "ab"), (5, ""), (6, "漢"), (7, "aa"), (8, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.doc_id for r in QUERIES["argsort"](spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [i for i, t in sorted(rows, key=lambda r: (r[1] is None, (r[1] or "").encode()[:1], r[0]))]
