"""Exact integer k-means with Hamerly's bounds.

Each vector carries one upper bound on the distance to its own centroid and one lower
bound on the distance to every other. When centroids move, the bounds are loosened by
how far: the upper one by its own centroid's drift, the lower one by the largest drift
of another. Where the upper bound stays under the lower one the vector keeps its
centroid unseen; the others are measured again, first against their own centroid, then
against all, in exact integers. Bounds are rounded outwards, so they only save work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm.common import Store, arrow_batches

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
#: Components up to here have squared distances over 64 of them that 64-bit integers hold.
FAST = 1 << 27
#: Components beyond are taken as this; larger ones have distances that no long holds.
WIDEST = 1 << 62
LONGEST = (1 << 63) - 1
#: Vectors that are measured against all centroids together.
SCANNED = 2048
_OUT, _IN = 1 + 1e-12, 1 - 1e-12


def usable(vector: Column, dimensions: int) -> Column:
    """Whether a vector has so many components, none of them null or not finite."""
    x = lambda v: v.cast("double")
    return F.coalesce((F.size(vector) == dimensions) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < float("inf"))), F.lit(False))


def _wide(*arrays: np.ndarray) -> bool:
    return any(a.size and max(int(a.max()), -int(a.min())) > FAST for a in arrays)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, as integers: of 64 bits where they surely fit, else of any size."""
    if _wide(x, c):
        x, c = x.astype(object), c.astype(object)
    d = x - c
    return (d * d).sum(axis=-1)


def _far(squared: np.ndarray) -> np.ndarray:
    """Distances as doubles."""
    return np.sqrt(squared.astype(np.float64))


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each row (least number at a tie), its distance, and the distance of the second nearest, as bounds."""
    which, upper, lower = np.zeros(len(x), np.int64), np.zeros(len(x)), np.full(len(x), np.inf)
    for lo in range(0, len(x), SCANNED):
        part = x[lo : lo + SCANNED]
        d = _squared(part[:, None, :], c[None])
        best = np.array([min(range(len(c)), key=r.__getitem__) for r in d]) if d.dtype == object else d.argmin(axis=1)
        rows = np.arange(len(part))
        which[lo : lo + SCANNED], upper[lo : lo + SCANNED] = best, _far(d[rows, best]) * _OUT
        if len(c) > 1:
            rest = _far(d)
            rest[rows, best] = np.inf
            lower[lo : lo + SCANNED] = rest.min(axis=1) * _IN
    return which, upper, lower


def moved(x: np.ndarray, which: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """nearest() after centroids went from `before` to `after`, from the bounds of before; and how many rows were scanned in full."""
    drift = _far(_squared(before, after)) * _OUT
    first = int(drift.argmax())
    others = np.full(len(drift), drift[first])
    others[first] = np.delete(drift, first).max() if len(drift) > 1 else 0.0
    which, upper, lower = which.copy(), (upper + drift[which]) * _OUT, (lower - others[which]) * _IN
    open_ = np.flatnonzero(~(upper < lower))
    upper[open_] = _far(_squared(x[open_], after[which[open_]])) * _OUT
    open_ = open_[~(upper[open_] < lower[open_])]
    which[open_], upper[open_], lower[open_] = nearest(x[open_], after)
    return which, upper, lower, len(open_)


def _vectors(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _centroids(state: DataFrame, c: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each centroid's vectors; the old one where it has none. Sums combine before the shuffle."""
    dimensions = c.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(c.shape, object), np.zeros(len(c), np.int64)
        for batch in batches:
            x, which = _vectors(batch["x"], dimensions), batch["cluster"].to_numpy()
            if not len(which):
                continue
            order = np.argsort(which, kind="stable")
            names, starts = np.unique(which[order], return_index=True)
            x = x[order].astype(object) if max(int(x.max()), -int(x.min())) > LONGEST // len(x) else x[order]
            total[names] += np.add.reduceat(x, starts, axis=0).astype(object)
            count += np.bincount(which, minlength=len(c))
        k = np.flatnonzero(count)
        if len(k):
            place = np.tile(np.arange(dimensions), len(k))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k, dimensions)), pa.array(place), pa.array(np.repeat(count[k], dimensions)), pa.array([int(v) for v in total[k].reshape(-1)], pa.decimal128(38, 0))], names=["k", "place", "n", "total"])

    out = c.copy()
    for r in state.select("x", "cluster").mapInArrow(sums, "k long, place long, n long, total decimal(38,0)").groupBy("k", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r["k"], r["place"]] = int(r["total"]) // r["n"]
    return out


def clusters(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = 2, scale: int = SCALE) -> DataFrame:
    """Cluster of every vector after `rounds` rounds of exact k-means, and sums over clusters.

    Returns one row per kept row: id_col, cluster, distance (squared, to the final
    centroid), cluster_inertia, inertia, centroid_sha256. Kept are vectors of exactly
    `dimensions` components, none null or not finite; a component x counts as
    floor(scale * x). The first centroids are the k kept vectors whose
    sha256 of "<seed>:<id>" is least (rows equal in id: the lesser vector first); rows
    with a null id never are, but are assigned. Fewer vectors than k give fewer
    clusters, none an empty result. Repeated rows each count. At a tie the centroid of
    lesser number wins. Other columns are not read. Components beyond 2**62 count as
    that; distances and inertias that no long holds are given as the largest long.

    What reaches the driver in a round is one sum per centroid and component. State is
    written to the shared folder every round.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    store = Store(spark, "hamerly")
    whole = F.transform(F.col(vector_col), lambda v: F.least(F.greatest(F.floor(F.lit(float(scale)) * v.cast("double")), F.lit(-WIDEST)), F.lit(WIDEST)).cast("long"))
    kept = store.keep(vectors.where(usable(F.col(vector_col), dimensions)).select(F.col(id_col).cast("long").alias("id"), whole.alias("x")), "vectors")
    # ids are few enough to order by: only the first k reach the driver
    first = kept.where("id is not null").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), "id", "x").limit(k).collect()
    schema = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    c = np.array([r["x"] for r in first], np.int64)

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, upper, lower = nearest(_vectors(batch["x"], dimensions), c)
            yield _state(batch, which, upper, lower)

    def stepped(before: np.ndarray, after: np.ndarray):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                which, upper, lower, _ = moved(_vectors(batch["x"], dimensions), *(batch[n].to_numpy() for n in ("cluster", "upper", "lower")), before, after)
                yield _state(batch, which, upper, lower)

        return step

    shape = "id long, x array<long>, cluster long, upper double, lower double"
    state = store.keep(kept.mapInArrow(begun, shape), "state")
    for _ in range(rounds):
        after = _centroids(state, c)
        now = store.keep(state.mapInArrow(stepped(c, after), shape), "state")
        store.drop(state)
        state, c = now, after

    final, digests = c, [hashlib.sha256(",".join(map(str, r.tolist())).encode()).hexdigest() for r in c]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = batch["cluster"].to_numpy()
            d = _squared(_vectors(batch["x"], dimensions), final[which])
            d = np.array([min(int(v), LONGEST) for v in d], np.int64) if d.dtype == object else d
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(which.astype(np.int32)), pa.array(d), pa.array([digests[i] for i in which], pa.string())], names=[id_col, "cluster", "distance", "centroid_sha256"])

    told = store.keep(state.mapInArrow(measured, f"{id_col} long, cluster int, distance long, centroid_sha256 string"), "told")
    fits = lambda s: F.least(s, F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    own = told.groupBy(F.col("cluster").alias("of_")).agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum_"))
    total = own.agg(F.sum("sum_").alias("all_"))
    # at most k rows, and one
    both = told.join(F.broadcast(own), told["cluster"] == own["of_"]).join(F.broadcast(total), F.lit(True))
    return both.select(id_col, "cluster", "distance", fits(F.col("sum_")).alias("cluster_inertia"), fits(F.col("all_")).alias("inertia"), "centroid_sha256")


def _state(batch: pa.RecordBatch, which: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch["id"], batch["x"], pa.array(which), pa.array(upper), pa.array(lower)], names=["id", "x", "cluster", "upper", "lower"])


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty exact clusters of the embeddings."""
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

