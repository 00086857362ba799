import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortweave.llm import lattice_lm as L


def brute_word(pieces, word):
    """Sum over all segmentations, by plain recursion."""
    text = b" " + word

    def ways(i):
        if i == len(text):
            return 1.0
        return sum(p * ways(i + len(s)) for s, p in pieces.items() if text.startswith(s, i))

    return ways(0)


def brute_uses(pieces, word):
    text, out = b" " + word, Counter()

    def walk(i, path, p):
        if i == len(text):
            for s in path:
                out[s] += p
            return
        for s, q in pieces.items():
            if text.startswith(s, i):
                walk(i + len(s), [*path, s], p * q)

    walk(0, [], 1.0)
    return out


PIECES = {b" ": 0.1, b"a": 0.1, b"b": 0.1, b" a": 0.2, b"ab": 0.2, b"aba": 0.1, b" ab": 0.05, b"ba": 0.15}


def test_lattice_against_all_segmentations():
    names = sorted(PIECES)
    trie, log_p = L.Trie.of(names), np.log([PIECES[n] for n in names])
    words = [b"a", b"ab", b"abab", b"bbb", b"ababab" * 2, b""]
    np.testing.assert_allclose(np.exp(L.log_probabilities(trie, log_p, words)), [brute_word(PIECES, w) for w in words])
    n = np.array([1, 2, 3, 1, 5, 1])
    want = Counter()
    for w, m in zip(words, n, strict=True):
        z = brute_word(PIECES, w)
        for s, u in brute_uses(PIECES, w).items():
            want[s] += m * u / z
    np.testing.assert_allclose(L.expected_counts(trie, log_p, words, n), [want[x] for x in names])


def test_long_words_by_the_same_recursion(monkeypatch):
    names = sorted(PIECES)
    trie, log_p = L.Trie.of(names), np.log([PIECES[n] for n in names])
    words, n = [b"ab" * 9, b"bab" * 5], np.array([2, 3])
    a, b = L.log_probabilities(trie, log_p, words), L.expected_counts(trie, log_p, words, n)
    monkeypatch.setattr(L, "LONG", 3)
    np.testing.assert_allclose(L.log_probabilities(trie, log_p, words), a)
    np.testing.assert_allclose(L.expected_counts(trie, log_p, words, n), b)


def brute_base(rows):
    """doc_id -> (held, n_tokens, n_known, N, base)."""
    held = {d: zlib.crc32(str(d if d is not None else "").encode()) % 7 == 2 for d, _ in rows}
    tokens = {d: [*(t or "").encode().lower().split(), None] for d, t in rows}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in tokens.items()}


ROWS = [(i, f"The w{i % 9} cat{i % 4} Älter sat{i}\x0bon\x0c x{i % 5}") for i in range(80)] + [(100, None), (101, ""), (102, "X" * 3000 + " a"), (None, "null"), (103, " \n\t "), (104, "a b ▁x")]


@pytest.mark.parametrize("rows", [ROWS, [], [(2, None)], [(0, "one")]])
def test_baseline_against_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, K1 int").withColumn("held_out", L.ascii_crc_bucket(F.col("doc_id"), 7) == 2)
    got = {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in L.score(df, block=600).collect()}
    want = brute_base(rows)
    assert got.keys() == want.keys()
    for d, w in want.items():
        assert got[d][:4] == w[:4], (d, got[d], w)
        assert got[d][4] == pytest.approx(w[4], abs=1e-6)
        assert got[d][5] < 0


def test_pieces_and_stop_are_distributions():
    pieces = [p for p, _ in L.vocabulary()]
    log_p, stop = L.normalise(pieces, np.zeros(len(pieces)), 1.0)
    begins = np.array([p[:1] == b" " for p in pieces])
    assert np.exp(log_p[begins]).sum() == pytest.approx(1)
    assert np.exp(log_p[~begins]).sum() + np.exp(stop) == pytest.approx(1)


def test_learning_helps_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = L.score(docs.withColumn("held_out", L.ascii_crc_bucket(F.col("doc_id"), 7) == 2)).where("held_out").toPandas()
    none = L.score(docs.withColumn("held_out", F.lit(True))).where(L.ascii_crc_bucket(F.col("doc_id"), 7) == 2).toPandas()
    assert some.score.sum() > 0.6 * none.score.sum()


def test_scores_against_brute_force(spark):
    """A vocabulary with log-probabilities weights the lattice as it is: each score, by all segmentations of each word."""
    rows = [(i, " ".join(["ab", "aba", "b", "abab"][: 1 + i % 4]), i % 5 == 0) for i in range(30)] + [(90, "bbaab ab AB", True), (91, None, True), (91, "ab", False), (91, "ab", False), (None, "aab", True), (92, "b" * 700, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    table = [(p, math.log(w)) for p, w in PIECES.items()]
    begin, rest = (sum(w for p, w in PIECES.items() if (p[:1] == b" ") == b) for b in (True, False))
    proper = {p: w / (begin if p[:1] == b" " else rest + 1) for p, w in PIECES.items()}
    stop = 1 / (rest + 1)
    tokens = [[*(t or "").lower().encode().split(), None] for _, t, _ in rows]
    c = Counter(w for ws, (_, _, held) in zip(tokens, rows, strict=True) if not held for w in ws)
    n, v = sum(c.values()), len(c)

    def of(w):
        if w is not None and len(w) > 50:  # only one way, and too small for a number
            return math.log10((v + 0.5) * stop * proper[b" "] / (n + v + 1)) + len(w) * math.log10(proper[b"b"])
        share = 0.5 if w is None else (v + 0.5) * stop * brute_word(proper, w)
        return math.log10((c[w] + share) / (n + v + 1))

    for block in (10, 1 << 20):
        got = sorted((str(r.doc_id), round(r.score, 6)) for r in L.score(docs, pieces=table, block=block).collect())
        assert got == sorted((str(d), round(sum(map(of, ws)), 6)) for (d, _, _), ws in zip(rows, tokens, strict=True))


def test_more_rounds_explain_training_words_better(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("held_out", L.ascii_crc_bucket(F.col("doc_id"), 7) == 2)
    sums = [L.score(docs, rounds=r).where("held_out").agg(F.sum("score")).first()[0] for r in (0, 1, 2)]
    assert sums == sorted(sums)
