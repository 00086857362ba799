from collections import Counter

from sortweave.llm import curriculum


def test_op9_deals_positions(spark, sf, monkeypatch):
    made = []
    for name in ("occurrences", "keep"):
        f = getattr(curriculum, name)
        monkeypatch.setattr(curriculum, name, lambda *a, f=f: (made.append((a[-1], out := f(*a))), out)[1])
    got = curriculum.op9_curriculum_mix(spark, sf).collect()
    dealt = [out for name, out in made if name == "mix-order"]
    assert len(dealt) == 1
    rows = dealt[0].collect()
    assert all(0 <= r.position <= 1 for r in rows) and len({r.position for r in rows}) > len(rows) / 2
    words = Counter()
    for r in rows:
        words[r.row_id] += r.words
    assert sorted(words.values()) == sorted(r.taken for r in got if r.taken)
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_positions_come_in_order_and_follow_the_schedules(spark):
    """mix() gives rows in order of position, and over windows of the curriculum each source's share is its schedule's integral."""
    words = 40
    rows = [(i, " ".join([f"s{i % 2}"] * words), f"s{i % 2}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = curriculum.plan(docs, (1, 1), 1.0, 2.0)
    dealt = curriculum.occurrences(planned).join(planned.select("row_id", "place"), "row_id").collect()
    total = {p: sum(r.words for r in dealt if r.place == p) for p in (0, 1)}
    for place, tilt in enumerate(curriculum.TILTS):
        for begin in range(10):
            a, b = begin / 10, (begin + 1) / 10
            expected = (b + tilt * (b - b * b)) - (a + tilt * (a - a * a))
            got = sum(r.words for r in dealt if r.place == place and a <= r.position < b) / total[place]
            assert abs(got - expected) < 0.01, (place, begin, got, expected)
    mixed = curriculum.mix(docs, (1, 1), 1.0, 2.0)
    order = [r.doc_id for r in mixed.collect()]
    ids = {r.row_id: r.doc_id for r in planned.collect()}
    where = {}
    for r in dealt:
        where.setdefault(ids[r.row_id], []).append(r.position)
    places = [where[i].pop(0) for i in order]
    assert len(places) == len(dealt) and places == sorted(places)
    early = [i % 2 for i in order[: len(order) // 5]]
    assert early.count(0) > 1.5 * early.count(1)  # the first source falls from 1.5 to 0.5, the second rises


def test_op9_edges(spark):
    """Nulls, blank and very long texts, repeated rows and clashing names."""
    rows = [(1, "a b c", "x", 1), (1, "a b c", "x", 1), (None, "d e", None, 2), (3, None, "x", 3), (4, "  ", "y", 4), (5, "w " * 300_000, "x", 5), (6, "", None, 6)]
    got = curriculum.curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string, SIZE int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.taken <= 2 * r.size and (r.first_position is None) == (r.taken == 0) == (r.turns == 0)
        assert r.taken == 0 or 0 <= r.first_position <= r.last_position <= 1
    assert {r.doc_id: r.size for r in got} == {1: 3, None: 2, 3: 0, 4: 0, 5: 300_000} | {6: 0}
    assert curriculum.curriculum(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
