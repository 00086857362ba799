import random

import numpy as np
import xxhash

from sortweave.llm import simhash
from sortweave.llm.components import components, forest


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def groups_of(n, near):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in near:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints():
    for t in (None, "", "one", "One TWO", "a b c", "É a b c d e" * 9, " \x0b x\x0cy\tz \n w ", "a b a b a b a b"):
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_no_pair_within_threshold_misses_its_home():
    rng = np.random.default_rng(5)
    x = rng.integers(-(2**63), 2**63 - 1, 3000)
    homes = simhash.home_anchors(x)
    for flips in range(3):
        y = x.copy()
        for _ in range(flips):
            y ^= np.int64(1) << rng.integers(0, 64, len(x))
        row, anchor = simhash.near_anchors(y)
        sent = set(zip(row.tolist(), anchor.tolist(), strict=True))
        assert len(sent) == len(row)
        assert all((i, h) in sent for i, h in enumerate(homes.tolist()))


def test_components_against_brute_force(spark):
    r = random.Random(2)
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    rows = []
    for g in range(12):
        words = [r.choice(base) for _ in range(300)]
        for _ in range(8):
            edit = [*words]
            for _ in range(r.randrange(3)):
                edit[r.randrange(300)] = r.choice(base)
            rows.append((len(rows) * 3 + 7, " ".join(edit)))
    rows += [(1, None), (2, ""), (4, " \n"), (5, "short"), (6, "SHORT"), (6, "short"), (None, "alone here"), (None, "short"), (900_000, "z" * 200_000)]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, FP int")
    fps = [brute_fingerprint(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    root = groups_of(len(rows), near)
    least = {}
    for i, g in enumerate(root):
        if rows[i][0] is not None:
            least[g] = min(least.get(g, 1 << 60), rows[i][0])
    got = simhash.near_duplicates(df).collect()
    assert sorted((str(x.doc_id), x.fp & (2**64 - 1), str(x.component_id)) for x in got) == sorted((str(d), f, str(least.get(g))) for (d, _), f, g in zip(rows, fps, root, strict=True))
    assert sum(x.kept for x in got) == len(set(root)) < len(rows)
    kept = simhash.dedupe(df)
    assert kept.columns == df.columns and kept.count() == len(set(root))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_chains_and_stars(spark):
    n = 40
    chain = [(i, i + 1) for i in range(n)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    random.Random(1).shuffle(chain)
    got = {r.id: r.root for r in components(spark.createDataFrame(chain, "a long, b long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {100 + i: 100 for i in range(1, 30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_keeps_components():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 60, 50), rng.integers(0, 60, 50)
    x, y = forest(a, b)
    assert len(x) < 60
    assert groups_of(60, zip(a.tolist(), b.tolist(), strict=True)) == groups_of(60, zip(x.tolist(), y.tolist(), strict=True))
