"""Ranks, edge sets and overlaps without ordering a whole table in one place.

Ranks that ties share come from the counts of distinct values: only those (few, as scores
are rounded combinations of 1..5 ratings) are put in order globally, and rows meet their
value by a join. Unique places are counted in ranges of value and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scorewright.operators.scan import numbered


def value_places(df: DataFrame, value: str, *, groups: list[str] | None = None, descending: bool = True) -> DataFrame:
    """groups, value, ties_ (rows with it) and before_ (rows ahead of it)."""
    groups = groups or []
    counts = df.groupBy(*groups, value).agg(F.count("*").alias("ties_"))
    order = F.col(value).desc() if descending else F.col(value).asc()
    w = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before_", F.coalesce(F.sum("ties_").over(w), F.lit(0)))


def competition_rank(df: DataFrame, value: str, name: str = "rank", *, groups: list[str] | None = None, descending: bool = True) -> DataFrame:
    """Ties share the least place."""
    places = value_places(df, value, groups=groups, descending=descending)
    return df.join(places, [*(groups or []), value]).withColumn(name, (F.col("before_") + 1).cast("long")).drop("ties_", "before_")


def average_rank(df: DataFrame, value: str, name: str = "rank", *, groups: list[str] | None = None) -> DataFrame:
    """Ties share the mean of their ascending places."""
    places = value_places(df, value, groups=groups, descending=False)
    return df.join(places, [*(groups or []), value]).withColumn(name, F.col("before_") + (F.col("ties_") + 1) / 2.0).drop("ties_", "before_")


def ordinal_rank(df: DataFrame, value: str, ties: list[Column], name: str = "rank", *, groups: list[str] | None = None, descending: bool = True) -> DataFrame:
    """Unique places; `ties` orders rows of one value. Rows are numbered in ranges of value and ties, so a common value is no one task's."""
    return numbered(df.where(F.col(value).isNotNull()), groups or [], [F.col(value).desc() if descending else F.col(value).asc(), *ties], name)


def edge_size(n: Column, share: float = 0.20, *, rounding: str = "ceil") -> Column:
    """Rows in the top (or bottom) share, at least one: rounded up, or half to even."""
    size = F.ceil(n * share) if rounding == "ceil" else F.bround(n * share, 0)
    return F.greatest(F.lit(1), size).cast("long")


def edge_flags(df: DataFrame, value: str, id_col: str, *, groups: list[str], share: float = 0.20, rounding: str = "ceil") -> DataFrame:
    """groups, id, in_top, in_bottom, edge_size. The top set is ordered by value and id descending, the bottom set by both ascending.

    Counts of values tell at which value each set ends: rows beyond it are in or out by
    their value alone. Only rows of that value are put in the order of their ids, in
    ranges of ids. Rows without a value are left out.
    """
    rows = df.where(F.col(value).isNotNull()).select(*groups, id_col, value)
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("n_")).select(*groups, edge_size(F.col("n_"), share, rounding=rounding).alias("edge_size"))
    ends = sizes
    for side, descending in (("top", True), ("bottom", False)):
        last = value_places(rows, value, groups=groups, descending=descending).join(sizes, groups).where("before_ < edge_size and before_ + ties_ >= edge_size")
        ends = ends.join(last.select(*groups, F.col(value).alias(f"{side}_value_"), (F.col("edge_size") - F.col("before_")).alias(f"{side}_room_")), groups)
    marked = rows.join(ends, groups)
    chosen = [_first_ids(marked, value, id_col, groups, side) for side in ("top", "bottom")]
    for c in chosen:
        marked = marked.join(c, [*groups, id_col], "left")
    v = F.col(value)
    inside = lambda side, beyond: beyond | ((v == F.col(f"{side}_value_")) & F.coalesce(f"{side}_first_", F.lit(False)))
    return marked.select(*groups, id_col, inside("top", v > F.col("top_value_")).alias("in_top"), inside("bottom", v < F.col("bottom_value_")).alias("in_bottom"), "edge_size")


def _first_ids(marked: DataFrame, value: str, id_col: str, groups: list[str], side: str) -> DataFrame:
    """groups, id, <side>_first_: of the rows at the value where a set ends, the ids that there is room for."""
    ties = marked.where(F.col(value) == F.col(f"{side}_value_")).select(*groups, id_col, f"{side}_room_")
    placed = numbered(ties, groups, [F.col(id_col).desc() if side == "top" else F.col(id_col).asc()], "place_")
    return placed.where(F.col("place_") <= F.col(f"{side}_room_")).select(*groups, id_col, F.lit(True).alias(f"{side}_first_"))
