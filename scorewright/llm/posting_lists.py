"""Approximate nearest neighbours over balanced posting lists.

Centroids come from balanced hierarchical clustering of a bounded sample. Every vector
goes into the list of its nearest centroid and, if it lies near a border, into those of
others as well; a list that grows long is stored in several blocks. A search walks a
graph of the centroids in memory, takes the lists whose centroids are not much
farther than the nearest, and measures what they hold on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from scorewright.llm.common import Store, arrow_batches

TOP = 10
#: Rows, and components in all, of the sample that centroids are fitted on.
SAMPLE_ROWS, SAMPLE_COMPONENTS = 1 << 16, 1 << 22
#: Most centroids, and components of all centroids: what is broadcast has at most 16 MB of them, and 80 bytes of graph for each.
CENTROIDS, CENTROID_COMPONENTS = 1 << 14, 1 << 21
#: Vectors that a list should hold at least, when there are few.
SMALL_LIST = 64
#: Lists of a vector, and how much farther than the nearest their centroids may lie.
REPLICAS, BORDER = 4, 0.10
#: How much farther than the nearest centroid the lists of a search may lie, and vectors that they should hold in any case.
REACH, LEAST_SEEN = 0.13, 512
#: Components of a block of a list, and searches that meet a block together.
BLOCK_COMPONENTS, SEARCHES = 1 << 16, 256
NEIGHBOURS, LINKS, ENTRIES, POOL = 16, 4, 32, 32
#: Nearest so far that a task holds before it thins them out.
HELD = 1 << 17
#: Components beyond are taken as this where centroids are searched.
_WIDEST = 1e100


@dataclass
class Model:
    """Centroids, how far their sample vectors lie, a share of the sample for each, and the graph that joins them."""

    centroids: np.ndarray
    radius: np.ndarray
    share: np.ndarray
    graph: np.ndarray
    entries: np.ndarray


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T)


def _split(x: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Parts of x by k-means in which a full part repels: each part's number of rows weighs on the distance to it."""
    c = x[rng.choice(len(x), parts, replace=False)]
    load = np.zeros(parts)
    for _ in range(6):
        d = _squares(x, c)
        which = (d + d.mean() * load).argmin(axis=1)
        count = np.bincount(which, minlength=parts)
        total = np.zeros_like(c)
        np.add.at(total, which, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        load += 0.1 * (count * parts / len(x) - 1)
    return which


def fit(sample: np.ndarray, k: int, seed: int = 11) -> Model:
    """About k centroids of a sample by splitting it again and again, and their graph."""
    rng = np.random.default_rng(seed)
    sample = np.clip(sample, -_WIDEST, _WIDEST)
    most, leaves, open_ = max(1, math.ceil(len(sample) / k)), [], [np.arange(len(sample))]
    while open_:
        rows = open_.pop()
        parts = min(16, math.ceil(len(rows) / most))
        if parts < 2:
            leaves.append(rows)
            continue
        which = _split(sample[rows], parts, rng)
        found = [rows[which == p] for p in range(parts)]
        found = [f for f in found if len(f)]
        if len(found) == 1:  # nothing tells these apart
            leaves.append(rows)
        else:
            open_ += found
    c = np.stack([sample[r].mean(axis=0) for r in leaves])
    radius = np.array([np.sqrt(((sample[r] - m) ** 2).sum(1)).mean() for r, m in zip(leaves, c, strict=True)])
    near = min(NEIGHBOURS, len(c) - 1)
    graph = np.zeros((len(c), near + (LINKS if near else 0)), np.int32)
    for lo in range(0, len(c), 1024):
        d = _squares(c[lo : lo + 1024], c)
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        if near:
            graph[lo : lo + 1024, :near] = np.argpartition(d, near - 1, axis=1)[:, :near]
    if near:
        graph[:, near:] = rng.integers(0, len(c), (len(c), LINKS))
    return Model(c, radius, np.array([len(r) for r in leaves]) / len(sample), graph, rng.permutation(len(c))[:ENTRIES])


def walked(x: np.ndarray, m: Model, pool: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest `pool` centroids of each row that a walk of the graph finds, nearest first, and their distances (infinite where there are fewer)."""
    n, width = len(x), max(1, min(pool, len(m.centroids)))
    row = np.arange(n)[:, None]
    seen = np.zeros((n, len(m.centroids)), bool)
    seen[:, m.entries] = True
    ids = np.tile(m.entries, (n, 1))
    d = _squares(x, m.centroids[m.entries])
    done = np.zeros(ids.shape, bool)
    step = 4
    while True:
        keep = np.argsort(d, axis=1, kind="stable")[:, :width]
        ids, d, done = np.take_along_axis(ids, keep, 1), np.take_along_axis(d, keep, 1), np.take_along_axis(done, keep, 1)
        waiting = np.where(done, np.inf, d)
        pick = np.argsort(waiting, axis=1, kind="stable")[:, :step]
        live = np.isfinite(np.take_along_axis(waiting, pick, 1))
        active = np.flatnonzero(live.any(axis=1))
        if not len(active) or not m.graph.shape[1]:
            return ids, np.sqrt(d)
        np.put_along_axis(done, pick, True, 1)
        around = m.graph[np.take_along_axis(ids, pick, 1)[active]].reshape(len(active), -1)
        around = np.where(np.repeat(live[active], m.graph.shape[1], axis=1), around, m.entries[0])
        around.sort(axis=1)
        fresh = ~seen[active[:, None], around]
        fresh[:, 1:] &= around[:, 1:] != around[:, :-1]
        seen[active[:, None], around] = True
        far = np.full((n, around.shape[1]), np.inf)
        r, k = np.nonzero(fresh)
        step_d = x[active[r]] - m.centroids[around[r, k]]
        far[active[r], k] = np.einsum("ij,ij->i", step_d, step_d)
        more = np.zeros((n, around.shape[1]), ids.dtype)
        more[active] = around
        ids, d = np.concatenate((ids, more), 1), np.concatenate((d, far), 1)
        done = np.concatenate((done, np.isinf(far)), 1)


def homes(x: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists that vectors are put in: the nearest, and up to REPLICAS - 1 more for those near a border."""
    ids, d = walked(np.clip(x, -_WIDEST, _WIDEST), m, POOL)
    inside = (d <= (1 + BORDER) * d[:, :1]) & np.isfinite(d)
    inside[:, 0] = True
    inside[:, REPLICAS:] = False
    r, k = np.nonzero(inside)
    return r, ids[r, k]


def reached(x: np.ndarray, m: Model, vectors: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists that searches look into.

    Those up to (1 + REACH) times as far as the nearest, or as that list's own vectors
    lie from its centroid where that is more; and, whatever their distance, the nearest
    ones until they should hold LEAST_SEEN vectors. The pool of the walk grows until the
    farthest centroid in it is out of reach.
    """
    x = np.clip(x, -_WIDEST, _WIDEST)
    rows, lists, left, pool = [], [], np.arange(len(x)), 2 * POOL
    while len(left):
        ids, d = walked(x[left], m, pool)
        bound = (1 + REACH) * np.maximum(d[:, 0], m.radius[ids[:, 0]])
        held = np.cumsum(np.where(np.isfinite(d), m.share[ids], 0) * vectors, axis=1)
        want = np.isfinite(d) & ((d <= bound[:, None]) | (np.concatenate((np.zeros((len(d), 1)), held[:, :-1]), 1) < LEAST_SEEN))
        want[:, 0] = True
        whole = ~want[:, -1] | (pool >= len(m.centroids))
        r, k = np.nonzero(want & whole[:, None])
        rows.append(left[r])
        lists.append(ids[r, k])
        left, pool = left[~whole], 4 * pool
    return (np.concatenate(rows), np.concatenate(lists)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def nearest(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of c, distance) of the k nearest of each row of q, ties to the lesser id.

    Products choose what may be among them, with a margin for their rounding; those
    are measured exactly.
    """
    with np.errstate(all="ignore"):
        size = (q * q).sum(1)[:, None] + (c * c).sum(1)[None]
        rough, slack = size - 2 * q @ c.T, 1e-12 * size
        if len(c) > k:
            bar = np.partition(rough + slack, k - 1, axis=1)[:, k - 1]
            r, s = np.nonzero(~(rough - slack > bar[:, None]))
        else:
            r, s = np.divmod(np.arange(len(q) * len(c)), len(c))
        d = np.sqrt(((q[r] - c[s]) ** 2).sum(1))
    order = np.lexsort((ids[s], d, r))
    r, s, d = r[order], s[order], d[order]
    first = np.searchsorted(r, np.arange(len(q)))
    good = np.arange(len(r)) - first[r] < k
    return r[good], s[good], d[good]


def _thinned(parts: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each search among (search, vector, distance) entries; a vector that stands in several lists once."""
    q, c, d = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((c, d, q))
    q, c, d = q[order], c[order], d[order]
    fresh = np.concatenate(([True], (q[1:] != q[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])))[: len(q)]
    q, c, d = q[fresh], c[fresh], d[fresh]
    good = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[good], c[good], d[good]


def _told(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["q", "cls", "score"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite and not all zero."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0), F.lit(False))


def neighbours(vectors: DataFrame, is_query: Column, *, top: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The `top` nearest found vectors of each query: query_id, rank (from 1), id_col, score (Euclidean distance).

    `is_query` is a condition on the columns of `vectors`; candidates are all rows but
    the query's own, ties go to the lesser id. Vectors that are null, empty, zero or hold
    a null or a component that is not finite take no part, nor do rows without an id. Of
    rows with one id the one with the least vector stands for it. Vectors are searched for
    among those with as many components. Fewer candidates than `top` give fewer rows; an
    empty table, or none that takes part, gives none. Other columns are not read.

    Equal vectors are one candidate with their least ids: of copies, which all tie, no
    more than top + 1 can be among a query's nearest and itself. So a vector that very
    many rows have is one entry of the lists, and is searched for once.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    store = Store(spark, "posting-lists")
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(usable(F.col("vec")))
    rows = store.keep(_one_each(store.keep(rows, "rows")), "single")
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    classes = rows.withColumn("nth", place).where(F.col("nth") <= top + 1).groupBy("vec").agg(F.min("id").alias("cls"), F.sort_array(F.collect_list("id")).alias("ids"))
    classes = store.keep(classes.withColumn("width", F.size("vec")), "classes")
    found = None
    for r in classes.groupBy("width").agg(F.count("*").alias("n")).orderBy("width").collect():
        one = _searched(classes.where(F.col("width") == r["width"]), rows.where("asks"), r["width"], r["n"], top, store)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _one_each(rows: DataFrame) -> DataFrame:
    """One row for each id. Ids are counted without their vectors; only those that repeat are looked at again."""
    twice = rows.groupBy("id").agg(F.count("*").alias("n_")).where("n_ > 1").select("id")
    least = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min("vec").alias("vec"), F.max("asks").alias("asks"))
    return rows.join(twice, "id", "left_anti").unionByName(least)


def _searched(classes: DataFrame, asking: DataFrame, width: int, n: int, top: int, store: Store) -> DataFrame:
    """query_id, rank, id, score of the queries among vectors of one width."""
    spark, most = classes.sparkSession, max(2, min(SAMPLE_ROWS, SAMPLE_COMPONENTS // width))
    # rows whose hash is under a share; a few more than asked for at most
    share = min(1.0, most / n)
    sample = classes.where(F.pmod(F.xxhash64(F.lit(7), "cls"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else classes
    drawn = sample.select("cls", "vec").orderBy("cls").toArrow()
    drawn = drawn if drawn.num_rows else classes.select("cls", "vec").limit(1).toArrow()
    drawn = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in drawn["vec"].chunks]).reshape(-1, width)
    k = max(1, min(CENTROIDS, CENTROID_COMPONENTS // width, len(drawn) // 4, int(2 * math.sqrt(n)), n // SMALL_LIST))
    shared = spark.sparkContext.broadcast(fit(drawn, k))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches):
            r, at = homes(_matrix(batch["vec"], width), shared.value)
            rows = batch.take(pa.array(r))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), rows["cls"], rows["vec"]], names=["list", "cls", "vec"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches):
            r, at = reached(_matrix(batch["vec"], width), shared.value, n)
            rows = batch.take(pa.array(r))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), rows["q"], rows["vec"]], names=["list", "q", "vec"])

    asks = store.keep(asking.select(F.col("id").alias("query_id"), "vec").join(classes.select("vec", F.col("cls").alias("q")), "vec").select("query_id", "q"), "asks")
    postings = store.keep(classes.select("cls", "vec").mapInArrow(put, "list int, cls long, vec array<double>"), "postings")
    probes = store.keep(classes.select(F.col("cls").alias("q"), "vec").join(asks.select("q").distinct(), "q").mapInArrow(asked, "list int, q long, vec array<double>"), "probes")
    held = _packed(postings, "cls", max(1, BLOCK_COMPONENTS // width), "block")
    searches = _packed(probes, "q", max(1, min(SEARCHES, BLOCK_COMPONENTS // width)), "part")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the blocks that a task meets, each search's nearest; told early where a task has very many searches."""
        kept, waiting = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                q, c = _matrix(one["q_vecs"], width), _matrix(one["cls_vecs"], width)
                names, ids = one["q_ids"].flatten().to_numpy(), one["cls_ids"].flatten().to_numpy()
                r, s, d = nearest(q, c, ids, top + 1)
                kept.append((names[r], ids[s], d))
                waiting += len(r)
                if waiting > HELD:
                    kept = [_thinned(kept, top + 1)]
                    if len(kept[0][0]) > HELD // 2:
                        yield _told(kept.pop())
                    waiting = sum(len(x[0]) for x in kept)
        if kept:
            yield _told(_thinned(kept, top + 1))

    near = held.join(searches, "list").select("q_ids", "q_vecs", "cls_ids", "cls_vecs").mapInArrow(measured, "q long, cls long, score double")
    # a class may be in several lists; of so many entries at least top + 1 differ
    best = near.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("score", "cls"))).where(F.col("nth") <= (top + 1) * REPLICAS)
    best = store.keep(best.groupBy("q", "cls").agg(F.min("score").alias("score")), "best")
    each = best.join(classes.select("cls", "ids"), "cls").select("q", "score", F.explode("ids").alias("id"))
    each = each.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))).where(F.col("nth") <= top + 1).drop("nth")
    own = asks.join(store.keep(each, "nearest"), "q").where("id <> query_id")
    return own.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id")).alias("rank"), "id", "score").where(F.col("rank") <= top)


def _packed(rows: DataFrame, key: str, most: int, block: str) -> DataFrame:
    """list, <key>_ids, <key>_vecs: the vectors of each list in blocks of about `most`; list sizes are at most CENTROIDS rows."""
    blocks = rows.groupBy(F.col("list").alias("l_")).agg(F.ceil(F.count("*") / most).alias("blocks_"))
    dealt = rows.join(F.broadcast(blocks), F.col("list") == F.col("l_")).withColumn(block, F.pmod(F.xxhash64(key), F.col("blocks_")))
    each = dealt.groupBy("list", block).agg(F.collect_list(F.struct(key, "vec")).alias("x_"))
    return each.select("list", F.transform("x_", lambda x: x[key]).alias(f"{key}_ids"), F.flatten(F.transform("x_", lambda x: x["vec"])).alias(f"{key}_vecs"))


def _bounded(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest embeddings of every hundredth one."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
