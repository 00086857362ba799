import math

from sortweave.llm import lattice_lm as L


def test_neither_blocks_nor_copies_decide_what_is_learnt(spark):
    texts = [f"alpha{i % 7} beta gamma{i} delta" for i in range(40)]
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(100, "gammadelta betabeta unseen", True)]
    at = lambda rows, block, parts: {r.doc_id: r for r in L.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(parts), block=block).collect()}[100]
    one, many = at(rows, 1 << 20, 1), at(rows, 200, 3)
    assert math.isclose(one.score, many.score, rel_tol=1e-9)


def test_words_of_copies_are_learnt(spark, monkeypatch):
    given = []
    normalise = L.normalise
    monkeypatch.setattr(L, "normalise", lambda pieces, w, stop: (given.append(stop), normalise(pieces, w, stop))[1])
    L.score(spark.createDataFrame([(i, "some copied words", False) for i in range(9)], "doc_id long, text string, held_out boolean"))
    assert math.isclose(math.exp(given[-1]), 3 + L.SMOOTH)
