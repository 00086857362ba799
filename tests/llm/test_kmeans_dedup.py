import numpy as np
import pytest

from sortweave.llm import kmeans_dedup
from sortweave.llm.kmeans_dedup import cells_of, fit, near_duplicates, unit


def brute(rows, threshold=0.98):
    n = len(rows)

    def sound(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    near = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la == lb and sound(a, la) and sound(b, lb) and len(a) == len(b):
                x, y = np.float32(a).astype(float), np.float32(b).astype(float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


def vectors(n, dims=6, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((8, dims))
    return [(i, [float(np.float32(x)) for x in base[rng.integers(8)] + rng.standard_normal(dims) * rng.choice([0.02, 0.15, 1])], int(rng.integers(2))) for i in range(n)]


EDGE = [
    (1000, None, 1), (1001, [0.0] * 6, 1), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1003, [float("nan")] + [1.0] * 5, 1), (1004, [float("inf")] + [1.0] * 5, 1),
    (1005, [1.0] * 6, None), (1006, [1.0] * 6, None), (1007, [1.0] * 6, 1), (1008, [2.0] * 6, 1), (1009, [1.0] * 5, 1), (1010, [1.0] * 6, 1), (1010, [1.0] * 6, 1), (None, [1.0] * 6, 1), (1011, [], 1),
]


@pytest.mark.parametrize(("rows", "blocks"), [(vectors(240) + EDGE, (7, 11)), (vectors(60), (1024, 4096)), ([], (1024, 4096)), (EDGE[:6], (4, 4))])
def test_against_brute_force(spark, monkeypatch, rows, blocks):
    monkeypatch.setattr(kmeans_dedup, "HOME_BLOCK", blocks[0])
    monkeypatch.setattr(kmeans_dedup, "OTHER_BLOCK", blocks[1])
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, VID string")
    got = [tuple(r) for r in near_duplicates(df, cell_rows=40).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_no_pair_is_lost_between_cells():
    rng = np.random.default_rng(3)
    x = unit(rng.standard_normal((400, 5)))
    y = unit(x + rng.standard_normal(x.shape) * 0.08)
    near = (x * y).sum(axis=1) >= 0.98
    centres = fit(x, 20)
    home = (x @ centres.T).argmax(axis=1)
    row, cell, _ = cells_of(y, centres, 0.98)
    sent = set(zip(row.tolist(), cell.tolist(), strict=True))
    assert near.sum() > 100
    assert all((i, home[i]) in sent for i in np.flatnonzero(near))


def test_components_of_any_finite_size(spark):
    """Doubles whose squares overflow or vanish are scaled; the result is that of ordinary ones."""
    rows = [(i, [x * scale for x in v], 1) for i, (scale, v) in enumerate([(1e300, [1.0, 2.0]), (1e-300, [1.0, 2.0]), (1.0, [1.0, 2.01]), (5e-324, [0.0, 1.0]), (1e308, [0.0, -1.0]), (1.0, [0.0, 3.0])])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (0, 4), 5: (1, 3)}


def test_single_precision_decides_nothing_at_the_threshold():
    rng = np.random.default_rng(5)
    x = unit(rng.standard_normal((300, 16)))
    side = rng.standard_normal(x.shape)
    side = unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    angle = np.arccos(0.98) + rng.choice([-1e-9, 1e-9, 1e-7, -1e-7, 1e-4, -1e-4], 300)
    y = x * np.cos(angle)[:, None] + side * np.sin(angle)[:, None]
    got = {(i, j) for a, b in kmeans_dedup.linked(x, y, 0.98, False) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(i, j) for i, j in zip(*np.nonzero(unit(x) @ unit(y).T >= 0.98), strict=True)}
    both = np.concatenate([x, y])
    once = [(i, j) for a, b in kmeans_dedup.linked(both, both, 0.98, True) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(set(once)) == len(once) and all(i < j for i, j in once) and {(i, j - 300) for i, j in once if i < 300 <= j} == got


def test_cells_grow_with_the_rows():
    assert [kmeans_dedup.cell_count(n, 100) for n in (0, 100, 101, 10_000, 10**6, 10**10)] == [1, 1, 2, 100, 1000, 10**5]
