import math

import numpy as np
from pyspark.sql import functions as F

from sortweave.llm import language_id as L


def brute(texts, language):
    """log p of each character by the textbook recursion, from raw n-grams."""
    n = L.ORDER
    top = {}
    for t in texts:
        padded = " " * (n - 1) + t
        for i in range(n - 1, len(padded)):
            g = padded[i - n + 1 : i + 1]
            top[g] = top.get(g, 0) + 1
    counts = {n: top}
    for k in range(n - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    size = len({g for g in counts[1]}) + 1

    def p(ctx, c):
        k = len(ctx) + 1
        if k == 0:
            return 1 / size
        lower = p(ctx[1:], c) if ctx else 1 / size
        own = {g: v for g, v in counts[k].items() if g[:-1] == ctx}
        once, twice = (sum(1 for v in counts[k].values() if v == x) for x in (1, 2))
        d = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
        if not own:
            return lower
        total = sum(own.values())
        return max(own.get(ctx + c, 0) - d, 0) / total + d * len(own) / total * lower

    return p


def test_models_match_the_recursion():
    texts = ["the cat sat on the mat", "a bat and the hat", "that is it"]
    codes, owner, counts = L.characters(texts)
    keys = L.grams(codes)[counts]
    k, c = np.unique(keys, return_counts=True)
    model = L.kneser_ney(k, np.zeros(len(k), np.int64), c, ["x"])
    p = brute(texts, "x")
    for text in ("the bat sat", "zzz the", "on it"):
        codes, _, counts = L.characters([text])
        got = model.log_p(L.grams(codes)[counts])[:, 0]
        padded = " " * 3 + text
        want = [math.log(p(padded[i - 3 : i], padded[i])) for i in range(3, len(padded))]
        np.testing.assert_allclose(got, want, atol=1e-4)


def test_documents_do_not_depend_on_their_neighbours():
    texts = ["One, two!", "", "drei vier", "\0", "Ünf 6"]
    def counted(some):
        codes, owner, counts = L.characters(some)
        return L.grams(codes)[counts], owner[counts]

    keys, owner = counted(texts)
    for i, t in enumerate(texts):
        assert keys[owner == i].tolist() == counted([t])[0].tolist()


def test_long_texts_in_stretches(monkeypatch):
    texts = ["the cat sat on the mat", "a bat and the hat"]
    k, c = np.unique(L._counted(texts)[0], return_counts=True)
    model = L.kneser_ney(k, np.zeros(len(k), np.int64), c, ["x"])
    long = "The cat, -- sat? on  the mat\n\n" * 5 + "..."
    whole = L.entropies(model, [long, "abc", long])
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(L, "STRETCH", size)
        for a, b in zip(whole, L.entropies(model, [long, "abc", long]), strict=True):
            np.testing.assert_allclose(a, b, rtol=1e-5)


def test_held_out_accuracy_and_edges(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    edge = spark.createDataFrame([(None, "x", "en"), (90001, None, "en"), (90002, "", None), (90003, "123 --- 456", "en"), (90004, "漢字仮名交じり文。" * 30, None), (90005, "a" * 300_000, None)], "doc_id long, text string, lang string")
    every = docs.select("doc_id", "text", "lang").unionByName(edge).withColumn("TEXT2", F.lit(1))
    held = L.ascii_crc_bucket(F.col("doc_id"), 4) == 2
    model = L.fit(every.where(~held))
    rows = L.predict(every, model, ("doc_id", "lang")).withColumn("held", held).collect()
    test = [r for r in rows if r.held and r.doc_id is not None and r.doc_id < 90000]
    assert len(test) > 100
    assert np.mean([r.lang == r.lang_pred for r in test]) > 0.97
    assert np.mean([r.rejected for r in test]) < 0.005
    assert all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (90001, 90002, 90003)] == ["und"] * 3
    assert by[90004].rejected
    kept = L.keep_identified(every).select("doc_id").collect()
    assert len(kept) == sum(not r.rejected for r in rows)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.predict(none, L.fit(none)).count() == 0
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.predict(one, L.fit(one)).first()["lang_pred"] == "und"
