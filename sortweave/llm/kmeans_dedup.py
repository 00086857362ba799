"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one kept row of each group.

A pair of vectors within the threshold's angle may lie in two cells. So each vector is also sent to every cell
in which a vector within that angle may be at home: those whose boundary with its own cell is no
further than the angle. A vector's links are found in its home cell, all of them, whatever the cells are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortweave.llm.common import columns_free_of, keep
from sortweave.llm.components import components, forest

#: Vectors on which cells are fitted: so many, or so many a cell if that is more.
SAMPLE, SAMPLE_CELL = 20_000, 4
#: Rows of a label that one cell should have; a label of fewer has one cell.
CELL_ROWS = 16_384
#: Rows of a cell's home vectors, and of the guests that they are compared with, that meet in one product; its rows at a time.
HOME_BLOCK, OTHER_BLOCK, STRIPE = 8192, 8192, 1024


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which rounds nothing: the largest component is from 0.5 to 1, so no square overflows or vanishes."""
    x = np.asarray(x, np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def cell_count(rows: int, cell_rows: int) -> int:
    """Cells of a label with so many rows: at most the square root of the rows, so that the centres stay small enough to send."""
    return max(1, min(-(-rows // cell_rows), math.isqrt(max(1, rows))))


def fit(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means: assign by the largest cosine, move to the mean direction."""
    points = unit(sample)
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(cells, len(points)), replace=False)]
    for _ in range(rounds):
        at = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        lost = np.sqrt((sums * sums).sum(axis=1)) < 1e-9
        sums[lost] = points[rng.choice(len(points), int(lost.sum()))]
        centres = unit(sums)
    return centres


def cells_of(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, at home) of each unit vector: its own cell, and all whose boundary is within the threshold's angle."""
    dots = x @ centres.T
    home = dots.argmax(axis=1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))[home]
    lead = dots[np.arange(len(x)), home][:, None] - dots
    near = lead <= (math.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-9) * gap
    near[np.arange(len(x)), home] = True
    row, cell = np.nonzero(near)
    return row, cell, cell == home[row]


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _assign(centres_of, threshold: float):
    """Rows (label, dim, vid, copies, v) with (cell, home): a row for its own cell, and one for each in which it is a guest."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                dims = part.column(1).to_numpy()
                for dim in np.unique(dims):
                    own = part.filter(pa.array(dims == dim))
                    row, cell, home = cells_of(unit(_vectors(own.column(4))), centres_of.value[int(dim)], threshold)
                    taken = own.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int32)), pa.array(home)], [*b.schema.names, "cell", "home"])

    return run


def linked(x: np.ndarray, y: np.ndarray, threshold: float, same: bool):
    """Stripes (i, j) of the pairs of a row of x and a row of y whose cosine is at least the threshold, in double precision; each
    pair once if both are the ``same``. A product in single precision decides all but those near the threshold."""
    x, y = unit(x), unit(y)
    fast_x, fast_y = x.astype(np.float32), y.astype(np.float32)
    slack = np.float32(1e-5 + x.shape[1] * 1.2e-7)
    for at in range(0, len(x), STRIPE):
        first = at if same else 0
        near = fast_x[at : at + STRIPE] @ fast_y[first:].T
        i, j = np.nonzero(near >= np.float32(threshold) - slack)
        unsure = np.flatnonzero(near[i, j] < np.float32(threshold) + slack)
        i, j = i + at, j + first
        keep_ = np.ones(len(i), bool)
        for k in range(0, len(unsure), 1 << 16):
            u = unsure[k : k + (1 << 16)]
            keep_[u] = np.einsum("ab,ab->a", x[i[u]], y[j[u]]) >= threshold
        if same:
            keep_ &= i < j
        yield i[keep_], j[keep_]


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """One pair of blocks: counts of links of home vectors, and a forest of them."""
        table = table.combine_chunks()
        side, kind = table["side"].to_numpy(), table["kind"][0].as_py()
        vid, copies = table["vid"].to_numpy(), table["copies"].to_numpy()
        same = kind == 0 and table["i"][0].as_py() == table["j"][0].as_py()
        dim = table["dim"][0].as_py()
        x = pa.concat_arrays(table["v"].chunks).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        n = np.zeros(len(vid))
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, j in linked(x[left], x[right], threshold, same):
            if not len(i):
                continue
            i, j = left[i], right[j]
            n += np.bincount(i, copies[j], len(vid))
            if kind == 0:  # both are at home here; a guest's links are counted in its own cell
                n += np.bincount(j, copies[i], len(vid))
            a, b = forest(np.concatenate([a, vid[i]]), np.concatenate([b, vid[j]]))
        some = n > 0
        none = pa.nulls(int(some.sum()), pa.int64())
        ids = pa.chunked_array([pa.array(vid[some]), pa.nulls(len(a), pa.int64())])
        counts = pa.chunked_array([pa.array(n[some].astype(np.int64)), pa.nulls(len(a), pa.int64())])
        return pa.table({"vid": ids, "n": counts, "a": pa.chunked_array([none, pa.array(a)]), "b": pa.chunked_array([none, pa.array(b)])})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label).

    Rows link when labels are equal and not null, dimensions are equal and the cosine in double precision is
    at least ``threshold``. Vectors that are null, empty or zero, or hold a null or non-finite component, and
    rows without a label, link with nothing; components of any finite size count. component_id is the smallest vec_id reachable, itself included
    (null only if none reachable has an id); kept is whether that is the row's own. Repeated rows are separate vectors
    that link with each other. An empty table gives an empty result; further columns are left out.

    Equal vectors of a label, told by 128 bits of hash, are folded into one with a count before anything is compared. A label of more than ``cell_rows`` has cells, whose
    centres are fitted on a sample (SAMPLE, SAMPLE_CELL); every vector is assigned. A vector goes to its own cell and, as a guest, to those in which
    one within the angle may be at home. Cells are cut into blocks of bounded size; each pair of home blocks meets once, and a
    block's links leave it as counts and a spanning forest, never as pairs. Vectors move in the precision that they are stored in.
    """
    spark = vectors.sparkSession
    wide = columns_free_of(vectors, ["vec_id", "embedding", "label"])
    kind = "array<float>" if dict(wide.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = wide.select(F.monotonically_increasing_id().alias("row_id"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("v"), F.col("label").cast("bigint").alias("label"))
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    hashed = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit("second"), "v").alias("k2")]
    rows = keep(rows.select("*", *hashed, F.coalesce(sound, F.lit(False)).alias("sound")), "vectors")
    same = ["label", "k1", "k2"]
    groups = rows.where("sound").groupBy(*same, "v").agg(F.count(F.lit(1)).alias("copies"), F.min("row_id").alias("vid"), F.min("vec_id").alias("least"))
    groups = keep(groups.withColumn("dim", F.size("v")), "vector-groups")

    large = keep(groups.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows), "vector-labels")
    centres = {}
    for dim, n in [(r["dim"], r["n"]) for r in large.groupBy("dim").agg(F.max("n").alias("n")).orderBy("dim").collect()]:
        cells = cell_count(n, cell_rows)
        sample = groups.where(F.col("dim") == dim).select("v", "vid").orderBy(F.xxhash64("vid"), "vid").limit(max(SAMPLE, SAMPLE_CELL * cells))
        centres[dim] = fit(np.array([r["v"] for r in sample.collect()]), cells)

    wanted = ["label", "dim", "vid", "copies", "v"]
    placed = groups.select(wanted).withColumn("cell", F.lit(0)).withColumn("home", F.lit(True))
    if centres:
        sent = spark.sparkContext.broadcast(centres)  # the square root of a label's rows at most, for each dimension
        split = large.select("dim", "label")
        big = groups.select(wanted).join(split, ["dim", "label"], "left_semi").select(wanted)
        assigned = big.mapInArrow(_assign(sent, threshold), T.StructType([*big.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("home", T.BooleanType())]))
        placed = keep(placed.join(split, ["dim", "label"], "left_anti").select(*wanted, "cell", "home").unionByName(assigned), "vector-cells")
    key = ["label", "dim", "cell"]
    blocks = placed.groupBy(key).agg(F.ceil(F.count_if("home") / HOME_BLOCK).cast("int").alias("homes"), F.ceil(F.count_if(~F.col("home")) / OTHER_BLOCK).cast("int").alias("others"))
    dealt = placed.join(blocks.where("homes > 0"), key).withColumn("salt", F.xxhash64("vid"))
    pair = lambda k, i, j, side: F.struct(F.lit(k).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.alias("side"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    own, guest = F.pmod("salt", F.col("homes")), F.pmod("salt", F.greatest("others", F.lit(1)))
    with_homes = F.transform(upto("homes"), lambda j: pair(0, F.least(own, j), F.greatest(own, j), (own > j).cast("int")))
    with_guests = F.transform(upto("others"), lambda j: pair(1, own, j, F.lit(0)))
    to_homes = F.transform(upto("homes"), lambda i: pair(1, i, guest, F.lit(1)))
    met = dealt.withColumn("e", F.explode(F.when(F.col("home"), F.concat(with_homes, with_guests)).otherwise(to_homes))).select(*key, "e.*", "vid", "copies", "v")
    met = met.groupBy(*key, "kind", "i", "j").applyInArrow(_compare(threshold), "vid bigint, n bigint, a bigint, b bigint")
    met = keep(met, "vector-links")

    counts = met.where("vid is not null").groupBy("vid").agg(F.sum("n").alias("n"))
    roots = components(met.where("a is not null").select("a", "b"))
    light = groups.select(*same, "vid", "copies", "least")
    rooted = light.join(roots, light["vid"] == roots["id"], "left").select(*same, "vid", "copies", "least", F.coalesce("root", "vid").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = rooted.join(least, "root").join(counts, "vid", "left").select(*same, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.where("sound").select("vec_id", *same).join(answer, same).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_spherical_kmeans_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, with their links and components."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
