"""I-Match fingerprints: terms within a band of inverse document frequency, hashed over randomised lexicon subsets.

The lexicon holds the terms whose share of documents lies within the band. Each component of a fingerprint belongs
to a random subset of it, of a fixed rate; a document's distinct terms in that subset are sorted and hashed
together, 0 if there are none. Low rates make components that depend on one or two terms only, so the share of equal
components falls gradually as texts differ.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortweave.llm.common import columns_free_of, keep, lean, utf8

#: Share of documents with a term, from rare to common: the band is ln(1/0.05) to ln(1/0.0001) of idf; a term is in 2 documents at least.
RARE, COMMON, FEWEST = 1e-4, 0.05, 2
#: Subset rates are 2**-level; so many subsets at each level.
LEVELS, EACH = (5, 6, 7, 8, 9, 10), 16
#: Terms of a lexicon that is sent to all executors (8 bytes each); a larger one is joined instead.
SENT_TERMS = 4_000_000
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def terms(text: str | None) -> np.ndarray:
    """Sorted hashes of a text's distinct lower-case words, without ASCII punctuation at their ends."""
    words = {w.strip(PUNCTUATION) for w in set(utf8(text).lower().split())}
    words.discard(b"")
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    """A random-looking 64-bit number for each (x, k)."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def components(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each document (sorted distinct term hashes flat[offsets[i]:offsets[i+1]]) its uint16 components."""
    n = len(offsets) - 1
    out = np.zeros((n, len(LEVELS) * EACH), np.uint16)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    for k in (*range(out.shape[1]), -1):
        member = _mix(flat, k + 1)
        if k >= 0:
            chosen = np.flatnonzero(member >> np.uint64(64 - LEVELS[k // EACH]) == 0)
        else:  # a document with terms in no subset has all of its terms in the first component
            chosen = np.flatnonzero(~out.any(axis=1)[owner])
        if not len(chosen):
            continue
        who = owner[chosen]
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        rank = np.arange(len(who)) - np.repeat(first, np.diff(np.concatenate([first, [len(who)]])))
        with np.errstate(over="ignore"):  # a hash of the sequence of sorted terms: each goes in with its rank
            sums = np.add.reduceat(_mix(member[chosen] + rank.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), k + 1), first)
        out[who[first], max(k, 0)] = np.maximum(_mix(sums, k + 1) >> np.uint64(48), 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal components among those that either has; 1 if neither has any."""
    either = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    return np.where(either > 0, same / np.maximum(either, 1), 1.0)


def in_band(flat: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only terms of the lexicon; a document without any keeps all of its terms, lest all such look alike."""
    at = np.minimum(np.searchsorted(lexicon, flat), max(0, len(lexicon) - 1))
    hit = lexicon[at] == flat if len(lexicon) else np.zeros(len(flat), bool)
    sums = np.concatenate([[0], np.cumsum(hit)])
    own = sums[offsets[1:]] - sums[offsets[:-1]]
    hit |= np.repeat(own == 0, np.diff(offsets))
    sums = np.concatenate([[0], np.cumsum(hit)])
    return flat[hit], sums[offsets]


def _flat(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(each) if each else np.zeros(0, np.uint64)), np.cumsum([0, *map(len, each)])


def _count(most: int = 1_000_000):
    """Document counts of terms, summed in a memory of ``most`` terms."""

    def run(batches):
        flat: list[np.ndarray] = []
        held, n = np.zeros((2, 0), np.uint64), 0
        for b in batches:
            for t in b.column(0):
                flat.append(terms(t.as_py()))
                n += len(flat[-1])
                if n > most:
                    held, flat, n = _sum(held, flat), [], 0
                    if held.shape[1] > most:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1].astype(np.int64))], ["term", "n"])
                        held = np.zeros((2, 0), np.uint64)
        held = _sum(held, flat)
        yield pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1].astype(np.int64))], ["term", "n"])

    def _sum(held, flat):
        keys, counts = np.unique(np.concatenate(flat), return_counts=True) if flat else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        both, row = np.unique(np.concatenate([held[0], keys]), return_inverse=True)
        sums = np.zeros(len(both), np.uint64)
        np.add.at(sums, row, np.concatenate([held[1], counts.astype(np.uint64)]))
        return np.stack([both, sums])

    return run


def lexicon(docs: DataFrame, rare: float = RARE, common: float = COMMON, fewest: int = FEWEST) -> DataFrame:
    """(term): hashes of terms in at least max(fewest, rare * N) and at most common * N of the N documents, kept.

    Of documents with d distinct terms each on average, d / rare terms at most are in the band. Counts are over all documents.
    """
    counts = columns_free_of(docs, ["text"]).mapInArrow(lean(_count()), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    total = docs.count()
    return keep(counts.where((F.col("n") >= max(fewest, rare * total)) & (F.col("n") <= max(fewest, common * total))).select("term"), "lexicon")


def _below(bounds: list[int]) -> Column:
    """How many of the sorted bounds are less than doc_id, by a search in steps of the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    less = lambda b: b < F.col("doc_id")
    steps = F.size(F.filter(F.array(*map(F.lit, bounds[::step])), less))
    rest = F.slice(F.array(*map(F.lit, bounds)), F.greatest(steps - 1, F.lit(0)) * step + 1, F.lit(step))
    return F.when(steps == 0, 0).otherwise((steps - 1) * step + F.size(F.filter(rest, less)))


def ranges(rows: DataFrame, n: int) -> tuple[Column, int]:
    """The range of each of (doc_id, h), ascending with (doc_id, null first; h), and how many there are, about ``n``.

    An id, or null, with more rows than a range should have is a range of its own, split by equal stretches of the hashes h.
    """
    total, known = rows.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    cuts = rows.select("doc_id").where("doc_id is not null").stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if known else []
    times = Counter(min(int(c), 2**63 - 1) for c in cuts)
    hot = {c for c, k in times.items() if k > 1}
    bounds = sorted(set(times) | {c - 1 for c in hot if c > -(2**63)})
    parts = [math.ceil(n * (total - known) / max(1, total)) or 1, *(times[b] + 1 if b in hot else 1 for b in bounds), 1]
    starts = np.cumsum([0, *parts]).tolist()
    at = F.when(F.col("doc_id").isNull(), 0).otherwise(_below(bounds) + 1)
    split, start = F.get(F.array(*map(F.lit, parts)), at), F.get(F.array(*map(F.lit, starts)), at)
    stretch = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * split)
    return (start + F.least(stretch, split - 1)).cast("int"), starts[-1]


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, look, doc_id, h, text), dealt out and sorted so that a row's next document comes right after it; and the number of partitions.

    Order: descending doc_id, null last; rows of one id by descending hash of the text. Documents go to ranges of ids and
    hashes, one a partition, so rows of one id, or without one, spread by their texts; the first row of each range is also sent, as a look-ahead, to the range before it (the very first to the last).
    The texts are shuffled once. Only one row of ids for each range reaches the driver.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = columns_free_of(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    bucket, n = ranges(rows, n)
    rows = rows.withColumn("bucket", bucket)
    heads = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("m")).orderBy("bucket").collect()
    before = [(r["m"]["doc_id"], r["m"]["h"], heads[(i + 1) % len(heads)]["bucket"]) for i, r in enumerate(heads)]
    looks = F.broadcast(spark.createDataFrame(before, "_id bigint, _h bigint, _to int"))  # a row for each range
    joined = rows.join(looks, rows["doc_id"].eqNullSafe(looks["_id"]) & (F.col("h") == F.col("_h")), "left")
    own, ahead = F.struct(F.col("bucket"), F.lit(False).alias("look")), F.struct(F.col("_to").alias("bucket"), F.lit(True).alias("look"))
    dealt = joined.withColumn("e", F.explode(F.when(F.col("_to").isNotNull(), F.array(own, ahead)).otherwise(F.array(own))))
    dealt = dealt.select("e.bucket", "e.look", "doc_id", "h", "text").repartitionById(n, "bucket")
    return dealt.sortWithinPartitions("bucket", "look", F.col("doc_id").desc_nulls_last(), F.col("h").desc()), n


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(batches, rows: int = 512, size: int = 2 << 20):
    """Chunks of (doc_ids, texts): the last of a chunk is only what follows the one before; buckets aren't mixed."""
    ids, texts, held, bucket, looked = [], [], 0, None, False
    for b in batches:
        for this, look, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4), strict=True):
            if this != bucket:
                ids, texts, held, bucket, looked = [], [], 0, this, False
            if looked:
                continue  # a copy of the look-ahead
            looked = look
            text = text.as_py()
            ids.append(doc_id)
            texts.append(text)
            held += len(text)
            if len(ids) > 1 and (look or len(ids) > rows or held > size):
                yield ids, texts
                ids, texts, held = ids[-1:], texts[-1:], len(text)


def _own_and_edited(ids, texts):
    changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    n_chars = np.fromiter(map(len, texts[:-1]), np.int64, len(changed))
    shas = [hashlib.sha256(utf8(t)).hexdigest() for t in changed]
    return n_chars, shas, [terms(t) for t in texts], [terms(t) for t in changed]


def _rows(ids, n_chars, shas, own, changed, following):
    hexes = lambda c: [r.tobytes().hex() for r in c.astype(">u2")]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(n_chars, pa.int64()), pa.array(shas, pa.string()), pa.array(hexes(own), pa.string()), pa.array(hexes(changed), pa.string()), pa.array(likeness(own, changed)), pa.array(likeness(own, following))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _direct(sent):
    def run(batches):
        for ids, texts in _pairs(batches):
            n_chars, shas, own, changed = _own_and_edited(ids, texts)
            a, b = (components(*in_band(*_flat(x), sent.value)) for x in (own, changed))
            yield _rows(ids[:-1], n_chars, shas, a[:-1], b, a[1:])

    return run


def _loose(batches):
    """As _direct, with all terms, for a lexicon that is joined. which: 0 own, 1 edited, 2 next."""
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    for ids, texts in _pairs(batches):
        n_chars, shas, own, changed = _own_and_edited(ids, texts)
        for i, doc_id in enumerate(ids[:-1]):
            lists = [pa.array([x.view(np.int64)], pa.list_(pa.int64())) for x in (own[i], changed[i], own[i + 1])]
            yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([doc_id], pa.int64()), pa.array([n_chars[i]]), pa.array([shas[i]]), *lists], ["row", "doc_id", "n_chars", "edited_sha256", "t0", "t1", "t2"])
            row += 1


def _joined(batches):
    for b in batches:
        parts = []
        for i in (4, 5, 6):
            lists = [np.unique(np.array(x, np.int64).view(np.uint64)) for x in b.column(i).to_pylist()]
            parts.append(components(*_flat(lists)))
        yield _rows(b.column(1).to_pylist(), b.column(2).to_numpy(), b.column(3).to_pylist(), *parts)


def fingerprints(docs: DataFrame, sent_terms: int = SENT_TERMS) -> DataFrame:
    """One row for each of (doc_id, text): its I-Match fingerprint, that of its edited text, and how alike they are.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (4 hex digits a component), near_edited, near_next.
    Equal texts have equal fingerprints. Null texts are empty; a text without any term has components of 0 only.
    Null doc_ids come last; repeated ids follow one another by descending XXH64 of the text; a lone document is its own next one; an empty table gives
    none; further columns are left out. A lexicon beyond ``sent_terms`` is joined with the documents' terms instead of sent.
    """
    spark = docs.sparkSession
    band = lexicon(docs)
    dealt, _ = with_next(docs)
    if (size := band.count()) <= sent_terms:
        known = np.sort(band.toPandas()["term"].to_numpy(np.int64).view(np.uint64)) if size else np.zeros(0, np.uint64)
        return dealt.mapInArrow(lean(_direct(spark.sparkContext.broadcast(known))), RESULT)
    loose = keep(dealt.mapInArrow(_loose, "row bigint, doc_id bigint, n_chars bigint, edited_sha256 string, t0 array<bigint>, t1 array<bigint>, t2 array<bigint>"), "imatch-terms")
    used = None
    for i in range(3):
        one = loose.select("row", F.lit(i).alias("which"), F.explode(f"t{i}").alias("term"))
        used = one if used is None else used.unionByName(one)
    hits = used.join(band, "term").groupBy("row").pivot("which", [0, 1, 2]).agg(F.collect_list("term"))  # a list is one document's terms
    chosen = [F.when(F.size(F.coalesce(F.col(str(i)), F.array())) > 0, F.col(str(i))).otherwise(F.col(f"t{i}")).alias(f"t{i}") for i in range(3)]
    return loose.join(hits, "row", "left").select("row", "doc_id", "n_chars", "edited_sha256", *chosen).mapInArrow(_joined, RESULT)


def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their edited texts."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
