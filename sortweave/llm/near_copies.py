"""Near copies of documents: SimHash fingerprints by anchors, then the exact similarity of five-word shingle sets.

What is compared comes from two sides. Fingerprints (of five-word shingles) within the threshold, found by anchors of the covering code as in
``simhash``; and, as near copies of a Jaccard similarity of 0.8 differ in more bits than anchors can cover, documents that share one of their rarest shingles. The
first words of a set, in any order that holds for all sets, must meet those of each set that is near to it: of n
shingles the first n - ceil(0.8 n) + 1. Shingles that many documents have come last in the order, told from a sample, which decides the cost, not what is near.

Each document is compared with one head of each of its first shingles, so that a large group costs a few comparisons a document. Then those pairs are left
that links don't join already and whose first common shingle may be one that they share here: so far along both sets that what is behind it
still suffices. In a group whose members differ too much to be near, each has its own shingles first, and nothing is left. Each pair that is compared is decided
exactly, and no near pair is lost.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortweave.llm.common import keep, lean, numbered, place_of, recorded, release, utf8
from sortweave.llm.components import components
from sortweave.llm.simhash import links as fingerprint_links
from sortweave.llm.simhash import majority

WORDS, SEED = 5, 42
#: Similarity as a fraction, so that no rounding decides: at least NEAR / OF.
NEAR, OF = 4, 5
#: For the order of shingles only: one in so many documents is sampled, and at most so many frequent shingles are sent.
SAMPLED, SENT = 16, 200_000
#: Rounds of heads, before the pairs that are left; they decide the cost, not the result.
ROUNDS = 2
#: Ids that are sent to all tasks to pick rows by; more are joined.
SENT_IDS = 4_000_000


def _hashes(text: str | None) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; one of all words where they are fewer; none for no words."""
    w = utf8(text).lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    each = map(b" ".join, zip(*(w[i:] for i in range(WORDS)), strict=False)) if len(w) >= WORDS else [b" ".join(w)]
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in each), np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(_hashes(text))


def prefix(hashes: np.ndarray, often: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The first shingles in the order of (count if frequent, else 0; hash) that a near set must share one of."""
    n = len(hashes)
    first = n - (NEAR * n + OF - 1) // OF + 1 if n else 0
    if not len(often):
        return hashes[:first]
    at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
    return hashes[np.lexsort((hashes, np.where(often[at] == hashes, count[at], 0)))[:first]]


def _sets(often):
    def run(batches):
        shingle, count = often.value
        for b in batches:
            out = []
            for t in b.column(2):
                each = _hashes(t.as_py())
                h = np.unique(each)
                k = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
                out.append((int(k[0]), int(k[1]), len(h), majority(each), prefix(h, shingle, count).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array([x[i] for x in out], pa.int64()) for i in range(4)), pa.array([x[4] for x in out], pa.list_(pa.int64()))], ["row_id", "doc_id", "k1", "k2", "n", "fp", "prefix"]
            )

    return run


def _all(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([shingles(t.as_py()).view(np.int64) for t in b.column(0)], pa.list_(pa.int64()))], ["hashes"])


def _among(column: pa.Array, ids: np.ndarray) -> np.ndarray:
    x = column.to_numpy(zero_copy_only=False)
    return ids[np.minimum(np.searchsorted(ids, x), len(ids) - 1)] == x if len(ids) else np.zeros(len(x), bool)


def _with(sent):
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_among(b.column(0), sent.value)))

    return run


def _without(sent):
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(~_among(b.column(0), sent.value)))

    return run


def _picked(table: DataFrame, ids: DataFrame, present: bool = True) -> DataFrame:
    """Rows of ``table`` whose first column is, or isn't, among the ids of one column. Up to SENT_IDS distinct ids, counted first, are sent to all, so that no
    text or set moves only to be picked."""
    ids = keep(ids.toDF("picked").distinct(), "near-ids")
    if ids.count() > SENT_IDS:
        return table.join(ids, F.col(table.columns[0]) == F.col("picked"), "left_semi" if present else "left_anti")
    sent = table.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow().column(0).to_numpy()))
    return table.mapInArrow(lean((_with if present else _without)(sent)), table.schema)


def _near(batches):
    made = lru_cache(64)(shingles)
    for b in batches:
        on = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            p, q = made(x.as_py()), made(y.as_py())
            both = len(np.intersect1d(p, q, assume_unique=True))
            on.append(OF * both >= NEAR * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(on, pa.bool_()))


def _like(n: str, m: str):
    return F.lit(OF) * F.least(n, m) >= F.lit(NEAR) * F.greatest(n, m)


def _may(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs (a, b), once, that may be near by the sizes of their sets and what their prefixes (id, n, prefix) share.

    Up to where the first of two prefixes ends, all that both sets have is in both prefixes; behind it there is at most the rest of that set.
    """
    distinct = keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "near-candidates")
    own = _picked(own, distinct.select("a").union(distinct.select("b")))
    both = distinct.join(own.toDF("a", "n", "p"), "a").join(own.toDF("b", "m", "q"), "b").where(_like("n", "m"))
    rest = F.ceil(F.lit(NEAR) * F.greatest("n", "m") / F.lit(OF)) - 1
    most = F.least(F.size(F.array_intersect("p", "q")) + rest, "n", "m")
    return both.where(F.lit(OF) * most >= F.lit(NEAR) * (F.col("n") + F.col("m") - most)).select("a", "b")


def _links(pairs: DataFrame, own: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Those of the pairs (a, b) whose sets are near, a kept table. Only the prefixes and texts that pairs name move."""
    with recorded() as used:
        may = keep(_may(pairs, own), f"{name}-pairs")
        texts = keep(_picked(docs.select("row_id", "text"), may.select("a").union(may.select("b"))), f"{name}-texts")
        left = may.join(texts.toDF("a", "x"), "a")
        both = left.join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(lean(_near), "a bigint, b bigint")
    links = keep(both, f"{name}-links")
    release(docs.sparkSession, used)
    return links


def _by_fingerprint(own: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs (a, b) of (id, fp): each with the first of its fingerprint, and the first ones of fingerprints that anchors bring together."""
    heads = keep(own.groupBy("fp").agg(F.min("id").alias("head")), "near-fingerprints")
    alike = own.join(heads, "fp").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    met = keep(fingerprint_links(heads.select("fp"), bits), "near-anchors").toDF("x", "y")
    across = met.join(heads.toDF("x", "a"), "x").join(heads.toDF("y", "b"), "y").select("a", "b")
    return alike.unionByName(across)


def _may_begin(n: str, i: str, m: str, j: str):
    """Whether a shingle at place i of n and place j of m may be the first that near sets have in common: all that both have is at or behind it in each."""
    share = F.ceil(F.lit(NEAR) * (F.col(n) + F.col(m)) / F.lit(NEAR + OF))
    return (F.col(n) - F.col(i) >= share) & (F.col(m) - F.col(j) >= share)


def _by_heads(met: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of (h, id, n, i, root): a head of each shingle, another one each turn, with those that links don't join to it already and whose first common shingle h may be."""
    # first the set in which the shingle comes earliest, as it has the fewest of its own before and so is near to the most
    head = F.min_by(F.struct("id", "n", "i", "root"), F.xxhash64(F.lit(turn), "id") if turn else F.struct("i", "id")).alias("head")
    heads = met.groupBy("h").agg(head, F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h", "head")
    stars = met.join(heads, "h").where((F.col("root") != F.col("head.root")) & _like("n", "head.n") & _may_begin("n", "i", "head.n", "head.i"))
    return stars.select(F.col("head.id").alias("a"), F.col("id").alias("b"))


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of at least three sampled documents, sorted, and in how many of these they are; the most frequent ones."""
    sample = docs.where(F.pmod(F.xxhash64("row_id"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(lean(_all), "hashes array<bigint>")
    counted = sample.select(F.explode("hashes").alias("h")).groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(SENT).toArrow()
    h, n = counted.column(0).to_numpy().view(np.uint64), counted.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _left(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of (h, id, n, i, root), i being the shingle's place in the order of its set, that links don't join and whose first common shingle h may be."""
    x, y = met.toDF("h", "a", "n", "i", "root1"), met.toDF("h", "b", "m", "j", "root2")
    return x.join(y, "h").where((F.col("a") < F.col("b")) & (F.col("root1") != F.col("root2")) & _like("n", "m") & _may_begin("n", "i", "m", "j")).select("a", "b")


def near_duplicates(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(row_id, doc_id, component_id, kept) for each row of a kept table (row_id BIGINT, doc_id, text).

    Rows link if their shingle sets are equal or near. component_id is the smallest doc_id that links reach; one row of each component is
    kept: the smallest doc_id, then the first row. Null and blank texts have the empty set and are one component. Null doc_ids
    count for no minimum. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("row_id", F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    often = spark.sparkContext.broadcast(_frequent(docs))
    rows = keep(docs.mapInArrow(lean(_sets(often)), "row_id bigint, doc_id bigint, k1 bigint, k2 bigint, n bigint, fp bigint, prefix array<bigint>"), "near-rows")
    groups = keep(rows.groupBy("k1", "k2").agg(F.min("row_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_id")).alias("first")), "near-groups")

    copies = rows.join(groups.where("copies > 1"), ["k1", "k2"]).where("row_id != id").select("row_id")
    single = _picked(rows.select(F.col("row_id").alias("id"), "n", "fp", "prefix"), copies, False)
    own = single.select("id", "n", "prefix")
    places = single.select("id", "n", F.posexplode("prefix").alias("i", "h"))
    twice = places.groupBy("h").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1").select("h")
    met = keep(places.join(twice, "h").select("h", "id", "n", "i"), "near-met").withColumn("root", F.col("id"))

    links = None
    for turn in range(rounds + 1):
        pairs = _by_heads(met, turn) if turn < rounds else _left(met)
        if links is None:
            links = _links(pairs.unionByName(_by_fingerprint(single.select("id", "fp"))), own, docs, "near-first")
        else:
            links = links.unionByName(_links(pairs, own, docs, "near-more"))
        roots = keep(components(links), "near-roots")
        if turn < rounds:
            met = keep(met.drop("root").join(roots, "id", "left").select("h", "id", "n", "i", F.coalesce("root", "id").alias("root")), "near-met")

    rooted = groups.join(roots, groups["id"] == roots["id"], "left").select("k1", "k2", "first", F.coalesce(roots["root"], groups["id"]).alias("root"))
    rooted = keep(rooted, "near-rooted")
    answer = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("least")), "root").select("k1", "k2", F.col("least.doc_id").alias("component_id"), F.col("least.row_id").alias("kept_row"))
    return rows.select("row_id", "doc_id", "k1", "k2").join(answer, ["k1", "k2"]).select("row_id", "doc_id", "component_id", (F.col("row_id") == F.col("kept_row")).alias("kept"))


def dedupe(docs: DataFrame) -> DataFrame:
    """The kept row of each component, with all columns of ``docs``. Rows are numbered once, in a kept table."""
    whole, names = numbered(docs, "near-docs")
    wanted = whole.select(F.col("_row").alias("row_id"), *(place_of(names, c).alias(c) for c in ("doc_id", "text")))
    marked = near_duplicates(wanted).where("kept").select(F.col("row_id").alias("_row"))
    return whole.join(marked.hint("shuffle_hash"), "_row", "left_semi").drop("_row").toDF(*names)
