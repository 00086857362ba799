"""SimHash near-duplicates, found by anchors of a covering code.

Anchors are pairs of codewords of the perfect binary Golay code of 23 bits, for bits 0-22 and 23-45 of a
fingerprint. The code covers its space with radius 3: each fingerprint has one home anchor. A fingerprint is
also sent to every anchor that a fingerprint within the threshold may have as home: those whose two distances,
each beyond the radius, add up to the threshold at most. Fingerprints that share an anchor are
compared over all 64 bits, so links are neither lost nor guessed.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortweave.llm.common import columns_free_of, keep, lean, numbered, place_of, utf8
from sortweave.llm.components import components

#: Fixed values of the code: length, message bits, covering radius, generator polynomial x^11+x^9+x^7+x^6+x^5+x+1.
LENGTH, MESSAGE, RADIUS, GENERATOR = 23, 12, 3, 0b101011100011
SEED = 42


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 for none. As a signed number."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    hashes = hashes.astype("<u8", copy=False)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 of the text's word shingles; 0 for no words."""
    w = utf8(text).lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), "<u8", max(1, len(w) - words + 1))
    return majority(hashes) & (1 << 64) - 1


def _fingerprints(words: int):
    def run(batches):
        for b in batches:
            text = b.column(b.num_columns - 1)
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in text), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps)], [*b.schema.names[:-1], "fp"])

    return run


@cache
def code_tables() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Error of the nearest codeword for each syndrome, and for each extra distance 1, 2 what else is near.

    The second holds (first, errors): for syndrome s, errors[first[s]:first[s+1]] lead to the codewords at
    distance RADIUS + extra.
    """
    words = [0]
    for i in range(MESSAGE):
        words += [x ^ (GENERATOR << i) for x in words]
    codewords = np.array(words, np.int64)
    checks = LENGTH - MESSAGE
    leaders = np.zeros(1 << checks, np.int64)
    for e in [0] + [1 << i for i in range(LENGTH)] + [1 << i | 1 << j for i in range(LENGTH) for j in range(i)] + [1 << i | 1 << j | 1 << k for i in range(LENGTH) for j in range(i) for k in range(j)]:
        leaders[int(syndromes(np.array([e]))[0])] = e
    weights = np.bitwise_count(leaders[:, None] ^ codewords[None, :])
    more = []
    for extra in (1, 2):
        s, c = np.nonzero(weights == RADIUS + extra)
        more.append((np.searchsorted(s, np.arange((1 << checks) + 1)), leaders[s] ^ codewords[c]))
    return leaders, more


def syndromes(y: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial."""
    r = y.astype(np.int64).copy()
    for bit in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
        r ^= np.where(r >> bit & 1, GENERATOR << (bit - (LENGTH - MESSAGE)), 0)
    return r


def _blocks(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = (1 << LENGTH) - 1
    return fps & mask, fps >> LENGTH & mask


def home_anchors(fps: np.ndarray) -> np.ndarray:
    leaders, _ = code_tables()
    first, second = ((y ^ leaders[syndromes(y)]) for y in _blocks(fps))
    return first | second << LENGTH


def near_anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor within covering radius plus threshold 2, home included."""
    leaders, more = code_tables()
    rows = np.arange(len(fps))
    near = []  # for each block: (row, codeword) by extra distance 0, 1, 2
    for y in _blocks(fps):
        s = syndromes(y)
        own = [(rows, y ^ leaders[s])]
        for first, errors in more:
            n = first[s + 1] - first[s]
            row = np.repeat(rows, n)
            at = np.repeat(first[s] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            own.append((row, y[row] ^ errors[at]))
        near.append(own)
    out = []
    for i, j in ((0, 0), (0, 1), (1, 0), (0, 2), (2, 0), (1, 1)):
        (ra, a), (rb, b) = near[0][i], near[1][j]
        n = np.bincount(rb, minlength=len(fps))
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        m = n[ra]
        at = np.repeat(starts[ra] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
        out.append((np.repeat(ra, m), np.repeat(a, m) | b[at] << LENGTH))
    return np.concatenate([r for r, _ in out]), np.concatenate([a for _, a in out])


def _anchors(near: bool):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                fps = b.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                if near:
                    row, anchor = near_anchors(fps)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[row])], ["anchor", "near_fp"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(home_anchors(fps)), pa.array(fps)], ["anchor", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3, row: str | None = None) -> DataFrame:
    """(row_id, doc_id, fp BIGINT) of each row of (doc_id, text), kept in the shared folder. ``row``: a column that numbers the rows."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = columns_free_of(docs, ["doc_id", "text", *([row] if row else [])]).select(number.alias("row_id"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return keep(rows.mapInArrow(lean(_fingerprints(words)), "row_id bigint, doc_id bigint, fp bigint"), "simhash")


def links(distinct_fps: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): pairs of different fingerprints with at most ``bits`` (0 to 2) differing bits, each once.

    Copies have been folded into one fingerprint, so a pair is a link between different fingerprints. A hot
    anchor is split by Spark's skew join, as no side needs an anchor's rows together.
    """
    if not 0 <= bits <= 2:
        raise ValueError("anchors cover up to 2 differing bits")
    homes = distinct_fps.mapInArrow(_anchors(False), "anchor bigint, fp bigint")
    near = distinct_fps.mapInArrow(_anchors(True), "anchor bigint, near_fp bigint")
    close = (F.col("fp") < F.col("near_fp")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("near_fp"))) <= bits)
    return near.join(homes.hint("shuffle_hash"), "anchor").where(close).select(F.col("fp").alias("a"), F.col("near_fp").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, row: str | None = None) -> DataFrame:
    """(row_id, doc_id, fp, component_id, kept) for each row of (doc_id, text).

    Fingerprints link at ``bits`` or fewer differing bits; component_id is the smallest doc_id that links
    reach, itself included; one row of each component is kept: the smallest doc_id, then the first row.
    Null and blank texts have fingerprint 0 and link like any other. Null doc_ids count for no minimum: the
    component_id of rows without any doc_id is null. Repeated rows and ties share a fingerprint; an empty
    table gives an empty result; further columns are left out.
    """
    rows = fingerprints(docs, words, row)
    groups = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_id")).alias("first"))
    groups = keep(groups, "simhash-groups")
    roots = components(links(groups.select("fp"), bits))
    rooted = groups.join(roots, groups["fp"] == roots["id"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("least"))
    answer = rooted.join(firsts, "root").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.row_id").alias("kept_row"))
    return rows.join(answer, "fp").select("row_id", "doc_id", "fp", "component_id", (F.col("row_id") == F.col("kept_row")).alias("kept"))


def op5_simhash_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints and components."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "kept")


def dedupe(docs: DataFrame) -> DataFrame:
    """The kept row of each component, with all columns of ``docs``. Rows are numbered once, in a kept table."""
    whole, names = numbered(docs, "simhash-docs")
    wanted = whole.select("_row", *(place_of(names, c).alias(c) for c in ("doc_id", "text")))
    marked = near_duplicates(wanted, row="_row").where("kept").select(F.col("row_id").alias("_row"))
    return whole.join(marked.hint("shuffle_hash"), "_row", "left_semi").drop("_row").toDF(*names)
