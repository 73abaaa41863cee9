"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import Store


def _hook(edges: DataFrame, larger_only: bool, store: Store) -> DataFrame:
    """Tie each node's neighbours to the least of them and itself.

    Minima come from a partial aggregate, are written, and meet the edges in a join
    that can be split, so a node with very many neighbours is never gathered in one place.
    """
    least = store.keep(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")), "least")
    joined = edges.join(least, edges["u"] == least["n"])
    if larger_only:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, store: Store, a: str = "a", b: str = "b") -> DataFrame:
    """Component of every node of `edges` (columns `a`, `b`; longs): rows (node, component), the least node reachable.

    Null ends and self loops are left out; repeated and reversed edges count once.
    An empty input gives an empty result. Each round is written to the shared
    folder; rounds end when the sum of the star centres stops changing.
    """
    now = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    now = store.keep(now, "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hook(both, True, store).where("u <> v").distinct()
        # small-star: each node's neighbours that are not larger; edges run from larger to smaller
        large = store.keep(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "large")
        small = _hook(large, False, store).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        after = store.keep(small, "star")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        store.drop(now)
        now = after
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
