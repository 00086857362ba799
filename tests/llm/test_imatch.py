import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sortweave.llm import imatch


def brute(rows):
    """doc_id -> (n_chars, edited sha, next text), by sorting everything."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (doc_id, text) in enumerate(order):
        t, n = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        out[doc_id] = (len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest(), t == n)
    return out


ROWS = [(i, f"word{i % 7} other{i % 5} éü{i} tail{i * i % 11} " * (i % 4 + 1)) for i in range(60)] + [(100, None), (101, ""), (102, "x"), (None, "null id"), (103, "  \n "), (104, "Same text here"), (105, "Same text here"), (107, "long " * 30000 + "end")]


@pytest.mark.parametrize("sent", [1000, 0])
@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], []])
def test_against_brute_force(spark, rows, sent):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, H string")
    got = imatch.fingerprints(df, sent).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == {k: v[:2] for k, v in brute(rows).items()}
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    if len(rows) > 1:
        assert by[104].fingerprint == by[105].fingerprint
        assert by[105].near_next == 1.0


def test_both_ways_agree(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    a, b = (sorted(imatch.fingerprints(df, n).collect(), key=str) for n in (1000, 0))
    assert a == b


def test_lexicon_counts_all_documents(spark):
    rows = [(i, f"common {'mid ' if i % 3 == 0 else ''}rare{i}") for i in range(60)]
    got = {r.term for r in imatch.lexicon(spark.createDataFrame(rows, "doc_id long, text string"), rare=0.1, common=0.5).collect()}
    assert got == set(imatch.terms("mid").view(np.int64).tolist())


def test_edits_are_nearer_than_other_documents(spark, sf):
    got = imatch.fingerprints(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")).toPandas()
    assert got.near_edited.mean() > got.near_next.mean() + 0.1
    assert (got.near_edited > got.near_next).mean() > 0.8


def test_components_are_those_of_sorted_distinct_terms():
    a, b = imatch.terms("a b c d e f " * 3), imatch.terms("F e d c b a")
    assert (a == b).all()
    flat, offsets = imatch._flat([a, imatch.terms("x"), a])
    c = imatch.components(flat, offsets)
    assert (c[0] == c[2]).all()
    assert (c[0] == imatch.components(*imatch._flat([a]))[0]).all()


def signed_hash(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_null_and_repeated_ids_spread_and_keep_their_order(spark):
    rows = [(None, f"none {i}") for i in range(300)] + [(7, f"seven {i}") for i in range(300)] + [(i, f"own {i}") for i in range(-50, 250)] + [(7, "seven 1"), (None, None), (2**63 - 1, "most"), (-(2**63), "least")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -signed_hash(r[1])))
    want = []
    for i, (doc_id, text) in enumerate(order):
        t, following = text or "", order[(i + 1) % len(order)][1] or ""
        want.append((doc_id, len(t), hashlib.sha256(imatch.edited(t, following).encode()).hexdigest()))
    got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in imatch.fingerprints(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)

    dealt, n = imatch.with_next(df)
    sizes = dealt.where("not look").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.sum() == len(rows) and sizes.max() <= 0.3 * len(rows)


def test_fingerprints_against_brute_force(spark):
    """Each component, from words by plain loops: the band by counting, the subset and the hash a term at a time."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60) % 400)) for i in range(80)]
    sets = {i: {w for w in t.split()} for i, t in rows}
    df = {w: sum(w in s for s in sets.values()) for s in sets.values() for w in s}
    band = {w for w, n in df.items() if max(2, 1e-4 * len(rows)) <= n <= max(2, 0.05 * len(rows))}
    full = (1 << 64) - 1

    def mix(x, k):
        x = ((x ^ (k * 0x9E3779B97F4A7C15 & full)) * 0xBF58476D1CE4E5B9) & full
        x ^= x >> 29
        x = x * 0x94D049BB133111EB & full
        return x ^ x >> 32

    def print_of(words):
        used = sorted(xxhash.xxh3_64_intdigest(w) for w in (words & band or words))
        out = []
        for k in range(96):
            members = [m for m in (mix(x, k + 1) for x in used) if m >> 64 - (5 + k // 16) == 0]
            total = sum(mix((m + r * 0xD6E8FEB86659FD93) & full, k + 1) for r, m in enumerate(members)) & full
            out.append(max(1, mix(total, k + 1) >> 48) if members else 0)
        return out

    def alike(a, b):
        either = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
        return sum(x == y for x, y in either) / len(either) if either else 1.0

    texts = dict(rows)
    got = {r.doc_id: r for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    checked = 0
    for i in texts:
        following = texts[(i - 1) % len(rows)]
        own, changed, other = (print_of(set(t.split())) for t in (texts[i], imatch.edited(texts[i], following), following))
        if not (any(own) and any(changed) and any(other)):
            continue
        checked += 1
        assert got[i].fingerprint == "".join(f"{x:04x}" for x in own)
        assert got[i].edited_fingerprint == "".join(f"{x:04x}" for x in changed)
        assert got[i].near_edited == pytest.approx(alike(own, changed)) and got[i].near_next == pytest.approx(alike(own, other))
    assert checked > 20
