"""Prefixes of ordered groups in two levels, so that a group of any size is worked on by many tasks.

Rows are dealt out by ranges of group and order and numbered where they lie. What a row
needs from before it comes from its own block, and from one summary row of each block
before; a window never holds more than the rows of one group in one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scorewright.sources.tables import keeper


class Blocks:
    """Rows of `df` by `groups`, in `order` (columns or sort expressions), written to the shared folder.

    `rows` has two more columns: block_ (ascending along a group) and nth_ (ascending in a
    block). Rows that `order` does not tell apart are put in one order or another, once. Null
    groups are groups.
    """

    def __init__(self, df: DataFrame, groups: list[str], order: list[str | Column], keep=None):
        self.groups, self.keep = groups, keep or keeper(df.sparkSession, "blocks")
        sort = [*groups, *order]
        place = F.monotonically_increasing_id()
        laid = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("at_", place)
        laid = laid.select(*df.columns, F.shiftright("at_", 33).cast("int").alias("block_"), F.col("at_").bitwiseAND((1 << 33) - 1).alias("nth_"))
        self.rows = self.keep(laid)
        self.inside = Window.partitionBy(*groups, "block_").orderBy("nth_")

    def with_before(self, **of: tuple[str, Column]) -> DataFrame:
        """rows with first_ (nth_ of the group's first row in the block) and, for each aggregate made by added() or carried(), its value over the blocks of the group before; null for the first."""
        key = [F.col(g).alias(f"g_{g}") for g in self.groups]
        one = self.rows.groupBy(*key, F.col("block_").alias("b_")).agg(F.min("nth_").alias("first_"), *[e.alias(n) for n, (_, e) in of.items()])
        earlier = Window.partitionBy(*[f"g_{g}" for g in self.groups]).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
        told = one.select(*[f"g_{g}" for g in self.groups], "b_", "first_", *[(F.last(n, ignorenulls=True) if how == "carried" else F.sum(n)).over(earlier).alias(n) for n, (how, _) in of.items()])
        on = F.col("block_") == F.col("b_")
        for g in self.groups:
            on = on & F.col(g).eqNullSafe(F.col(f"g_{g}"))
        return self.rows.join(told, on).drop("b_", *[f"g_{g}" for g in self.groups])


def added(total: Column) -> tuple[str, Column]:
    """An aggregate that adds up from block to block."""
    return "added", total


def carried(last: Column) -> tuple[str, Column]:
    """An aggregate whose latest value that is not null holds for the blocks after."""
    return "carried", last


def numbered(df: DataFrame, groups: list[str], order: list[str | Column], name: str, keep=None) -> DataFrame:
    """df with each row's place in its group, from 1."""
    rows = Blocks(df, groups, order, keep).with_before(n_=added(F.count("*")))
    return rows.select(*df.columns, (F.coalesce("n_", F.lit(0)) + F.col("nth_") - F.col("first_") + 1).cast("long").alias(name))
