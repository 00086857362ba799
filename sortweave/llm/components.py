"""Connected components of links between ids, by alternating stars over kept tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortweave.llm.common import keep, recorded, release


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, least id) that join just what the given links join: at most one for each id."""
    ids, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(ids))
    while True:
        rx, ry = root[x], root[y]
        low = np.minimum(rx, ry)
        before = root.copy()
        np.minimum.at(root, rx, low)
        np.minimum.at(root, ry, low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    child = root != np.arange(len(ids))
    return ids[child], ids[root[child]]


def _thin(most: int = 1 << 18):
    """Streams links (a, b) through forests of at most ``most`` links at a time."""

    def run(batches):
        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            if len(held[0]) > most:
                held = list(forest(*held))
                if len(held[0]) > most // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], ["a", "b"])
                    held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(h) for h in forest(*held)], ["a", "b"])

    return run


def thin(links: DataFrame) -> DataFrame:
    """Fewer links (a, b) with the same components; each task only sees its own."""
    return links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).mapInArrow(_thin(), "a bigint, b bigint")


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One star step. Least neighbours are aggregated before they are joined back, so a hub's row never
    waits for all of its links in one task, and Spark can split a skewed hub in the join."""
    if small:
        pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        pairs = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    if small:
        moved = pairs.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        moved = pairs.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root): for each id in a link, the least id it is joined to. Links are (a, b) BIGINT, in any order and
    repeated as they like. Ids that are their own root are not returned.

    Each round takes every id to the least neighbour of its neighbours and back; paths shrink to stars in a
    number of rounds that grows with the logarithm of the longest. Each round is kept in the shared folder.
    """
    with recorded() as before:
        links = keep(thin(links.where("a <> b")).distinct(), "links")
    seen = None
    while True:
        with recorded() as now:
            links = keep(_star(_star(links, False), True), "links")
        release(links.sparkSession, before)  # read for the last time
        before = now
        state = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return links.select(F.col("a").alias("id"), F.col("b").alias("root"))
        seen = state
