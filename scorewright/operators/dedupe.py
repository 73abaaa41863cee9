"""Duplicate rules that depend on order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeats(df: DataFrame, keys: list[str], order: list[str], name: str = "is_repeat") -> DataFrame:
    """Marks rows that follow another of the same key. The first of each key comes from an aggregate, so a frequent key is not gathered."""
    first = df.groupBy(*[F.col(k).alias(f"key_{k}") for k in keys]).agg(F.min(F.struct(*order)).alias("first_"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"key_{k}"))
    return df.join(first, on).select(*df.columns, (F.struct(*order) > F.col("first_")).alias(name))


def greedy_dedupe(df: DataFrame, keys: list[str], order: str, eligible: str, keep) -> DataFrame:
    """Adds `included`: in `order`, an eligible row is included unless an included row before it shares any of its keys.

    A fold over the rows, done in rounds over those that are undecided. A row with none
    before it in the groups of its keys is included. A row with just one before it is
    included if that one is not, so such rows make chains, and along a chain every
    second row is included: chains are contracted by doubling, a chain of n rows in
    log n joins. Then the groups of included rows are decided whole. Rounds are needed
    only where a row waits for several others.

    Rows that are not eligible neither enter nor block. `order` must be unique. `keep`
    writes a table and reads it back. Null keys are shared with nothing.
    """
    state, chosen = keep(df.where(eligible).select(order, *keys)), []
    while not state.isEmpty():
        new = keep(_next_included(state, keys, order, keep))
        chosen.append(new.select(F.col(order).alias("o_")))
        for k in keys:
            state = state.join(new.where(F.col(k).isNotNull()).select(F.col(k).alias(f"taken_{k}")).distinct(), F.col(k) == F.col(f"taken_{k}"), "left_anti")
        state = keep(state.join(new.select(F.col(order).alias("o_")), F.col(order) == F.col("o_"), "left_anti"))
    if not chosen:
        return df.withColumn("included", F.lit(False))
    every = reduce(DataFrame.unionByName, chosen).withColumn("in_", F.lit(True))
    return df.join(every, F.col(order) == F.col("o_"), "left").select(*df.columns, F.coalesce("in_", F.lit(False)).alias("included"))


def _next_included(state: DataFrame, keys: list[str], order: str, keep) -> DataFrame:
    """Of undecided rows those that are surely included: first in all their groups, or an even number of steps from such a row."""
    rows, here, links, waits = state, F.col(order), [], F.lit(False)
    for k in keys:
        first = state.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"key_{k}")).agg(F.min(order).alias(f"first_{k}"))
        later = state.join(first, F.col(k) == F.col(f"key_{k}")).where(here > F.col(f"first_{k}"))
        second = later.groupBy(F.col(k).alias("k_")).agg(F.min(order).alias(f"second_{k}"))
        places = first.join(second, F.col(f"key_{k}") == F.col("k_"), "left").drop("k_")
        rows = rows.join(places, F.col(k) == F.col(f"key_{k}"), "left")
        links.append(F.when(here == F.col(f"second_{k}"), F.col(f"first_{k}")))
        waits = waits | F.coalesce(here > F.col(f"second_{k}"), F.lit(False))
    before = F.array_distinct(F.array_compact(F.array(*links)))
    marked = keep(rows.select(order, *keys, F.when(waits, -1).otherwise(F.size(before)).alias("before_"), F.get(before, F.lit(0)).alias("to_")))
    roots = marked.where("before_ = 0")
    chain = keep(marked.where("before_ = 1").select(here.alias("row_"), "to_", F.lit(True).alias("odd_")))
    while True:
        on = chain.select(F.col("row_").alias("r_"), F.col("to_").alias("next_"), F.col("odd_").alias("more_"))
        longer = chain.join(on, F.col("to_") == F.col("r_"), "left")
        if longer.where("r_ is not null").isEmpty():
            break
        chain = keep(longer.select("row_", F.coalesce("next_", "to_").alias("to_"), (F.col("odd_") != F.coalesce("more_", F.lit(False))).alias("odd_")))
    ends = roots.select(here.alias("end_"))
    even = chain.where("not odd_").join(ends, F.col("to_") == F.col("end_"), "left_semi").select("row_")
    return roots.select(order, *keys).unionByName(marked.join(even, here == F.col("row_"), "left_semi").select(order, *keys))
