"""Review samples: strata, priorities, and seeded picks."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.operators.scoring import first_rows


def first_of_strata(df: DataFrame, strata: list[str], order: list[str], *, per: int = 1) -> DataFrame:
    """The first `per` rows of each stratum.

    Partial maxima keep only `per` rows of a stratum in each task before the shuffle,
    so a stratum of any size costs a few rows.
    """
    rest = [c for c in df.columns if c not in strata and c not in order]
    key = F.struct(*order, *rest)
    # min_by over one key at a time: the smallest, then the smallest of what is greater
    best = df.select(*strata, key.alias("row_"))
    picked = None
    for _ in range(per):
        least = best.groupBy(*strata).agg(F.min("row_").alias("row_"))
        picked = least if picked is None else picked.unionByName(least)
        least = least.withColumnRenamed("row_", "least_")
        best = best.join(least, strata).where(F.col("row_") > F.col("least_")).drop("least_")
    return picked.select(*strata, "row_.*")


def priority_documents(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n documents by `order` (a top-k: only n rows of each task meet)."""
    return df.orderBy(*order).limit(n)


def union_first(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of several picks, each key once, from the first pick that has it."""
    tagged = None
    for i, p in enumerate(parts):
        p = p.withColumn("pick_", F.lit(i))
        tagged = p if tagged is None else tagged.unionByName(p)
    return first_rows(tagged, [key], [F.col("pick_")])


def seeded_picks(size: int, n: int, seed: int = 42) -> list[int]:
    """Places of a seeded random sample without replacement from range(size), ascending."""
    return sorted(random.Random(seed).sample(range(size), min(n, size)))
