import random

import pytest

import corpus_pipeline
from sortweave.llm import near_copies


def sets(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("sent", [near_copies.SENT_IDS, 0])
def test_stage_joins_all_near_copies(spark, monkeypatch, sent):
    monkeypatch.setattr(near_copies, "SENT_IDS", sent)
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    line = " ".join(word() for _ in range(12))
    texts = [None, "", " \n", "two words", "Two  WORDS", "two words more"]
    for g in range(25):
        base = [word() for _ in range(r.choice([9, 40, 120]))]
        for _ in range(6):
            edit = [*base]
            for _ in range(r.randrange(5)):
                edit[r.randrange(len(edit))] = word()
            texts.append(" ".join(edit + (line.split() if g % 2 else [])))
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)] + [(None, texts[-1])]
    given = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = 0
    for i, a in enumerate(given):
        for j, b in enumerate(given[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                near += a != b
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert near > 20
    want = sorted({min(rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None) for i in range(len(rows))})
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert sorted(x.doc_id for x in got.collect()) == want
    assert near_copies.dedupe(df.limit(0)).count() == 0
