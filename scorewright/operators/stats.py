"""Reliability statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scorewright.functions.numbers import pearson_of
from scorewright.operators.ranking import average_rank
from scorewright.operators.scan import Blocks, added, numbered


def summary(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """n, mean, median, pstdev, min, max, p25 and p75 of a column (percentiles interpolate)."""
    x = F.col(value).cast("double")
    return df.groupBy(*(groups or [])).agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.percentile(x, F.lit(0.5)), 6).alias("median"), F.round(F.stddev_pop(x), 6).alias("pstdev"), F.min(x).alias("min"), F.max(x).alias("max"), F.round(F.percentile(x, F.lit(0.25)), 6).alias("p25"), F.round(F.percentile(x, F.lit(0.75)), 6).alias("p75"))


def correlation_matrix(long: DataFrame, *, id_col: str, code_col: str, value: str, codes: list[str]) -> DataFrame:
    """wide_correlations() of long rows."""
    return wide_correlations(long.groupBy(id_col).pivot(code_col, codes).agg(F.max(value)), codes)


def wide_correlations(wide: DataFrame, codes: list[str]) -> DataFrame:
    """All pairs of dimensions over documents that have both, from one pass over the wide rows."""
    pairs = [(a, b) for a in codes for b in codes]
    row = wide.agg(*[(F.lit(1.0) if a == b else pearson_of(a, b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("left_code"), F.lit(b).alias("right_code"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(rows))


def high_pairs(matrix: DataFrame, above: float = 0.85) -> DataFrame:
    return matrix.where((F.col("left_code") < F.col("right_code")) & (F.col("correlation") > above))


def spearman(df: DataFrame, x: str, y: str, *, groups: list[str] | None = None, least: int = 2) -> DataFrame:
    """groups, spearman: correlation of average ranks."""
    ranked = average_rank(average_rank(df, x, "rx_", groups=groups), y, "ry_", groups=groups)
    return ranked.groupBy(*(groups or [])).agg(pearson_of("rx_", "ry_", least=least).alias("spearman"))


def icc1(df: DataFrame, x: str, y: str) -> DataFrame:
    """ICC(1) of two runs: between and within mean squares, within [0, 1]; 0 under two documents or without variance."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    moments = df.where(a.isNotNull() & b.isNotNull()).agg(F.count("*").alias("n"), F.var_pop((a + b) / 2).alias("between"), F.sum((a - b) * (a - b) / 2).alias("within"))
    msb, msw = 2 * F.col("between") * F.col("n") / (F.col("n") - 1), F.col("within") / F.col("n")
    value = F.when((F.col("n") < 2) | (msb + msw == 0), F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (msb - msw) / (msb + msw))), 6))
    return moments.where("n >= 2").select("n", value.alias("icc")).unionByName(moments.where("n < 2").select("n", F.lit(0.0).alias("icc")))


def weighted_kappa(df: DataFrame, x: str, y: str, *, low: int = 1, high: int = 5) -> DataFrame:
    """n, kappa: quadratic weights over low..high; with no expected disagreement 1 if the raters agree throughout, else 0.

    Expected disagreement is the mean of (x - y) squared over independent raters,
    E[x^2] - 2 E[x] E[y] + E[y^2], so the marginals need no table of their own.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    span = float(high - low) ** 2
    both = df.where(a.between(low, high) & b.between(low, high))
    m = both.agg(F.count("*").alias("n"), F.avg((a - b) * (a - b) / span).alias("seen"), ((F.avg(a * a) - 2 * F.avg(a) * F.avg(b) + F.avg(b * b)) / span).alias("expected"))
    flat = F.when(F.col("seen") < 1e-12, 1.0).otherwise(0.0)
    return m.select("n", F.when(F.col("n") == 0, F.lit(0.0)).when(F.col("expected") < 1e-12, flat).otherwise(F.round(1 - F.col("seen") / F.when(F.col("expected") < 1e-12, F.lit(1.0)).otherwise(F.col("expected")), 6)).alias("kappa"))


def order_statistics(df: DataFrame, value: str, groups: list[str], *, shares: dict[str, float] | None = None, least: int = 10, cut: float = 0.1) -> DataFrame:
    """groups, n, trimmed_mean and a column for each named share: exact, for groups of any size.

    trimmed_mean leaves out the lowest and highest max(1, int(cut * n)) values; in groups
    under `least` rows none. A share p is the value at place (n - 1) * p, between two places
    in proportion. Null values are left out; a group without others gives no row.

    Equal values are counted together and laid out in ranges, and counts of ranges say
    at which places each begins. Ranges between the two cuts add their sums; only in ranges
    that a cut or a wanted place falls into, a handful of a group, are values counted one by one.
    """
    x = F.col(value).cast("double")
    shares = shares or {}
    counts = df.where(x.isNotNull()).groupBy(*groups, x.alias("x_")).agg(F.count("*").alias("k_"))
    b = Blocks(counts, groups, ["x_"])
    names = [f"g_{g}" for g in groups]
    same = reduce(lambda p, q: p & q, [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(groups, names, strict=True)])
    sizes = counts.groupBy(*[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)]).agg(F.sum("k_").alias("n_"))
    sizes = sizes.withColumn("cut_", F.when(F.col("n_") < least, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.col("n_") * cut))))
    rows = b.with_before(upto_=added(F.sum("k_"))).withColumn("upto_", F.coalesce("upto_", F.lit(0))).join(sizes, same).drop(*names)
    blocks = rows.groupBy(*groups, "block_", "n_", "cut_").agg(F.first("upto_").alias("from_"), F.sum("k_").alias("rows_"), F.sum(F.col("k_") * F.col("x_")).alias("sum_"))
    low, high, n = F.col("cut_"), F.col("n_") - F.col("cut_"), F.col("n_")
    place = lambda p: (n - 1) * F.lit(float(p))
    places = {(name, side): f(place(p)) for name, p in shares.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}

    def holds(begin, end):
        """Which cuts and places lie in begin..end-1."""
        return reduce(lambda p, q: p | q, [(begin < low) & (low < end), (begin < high) & (high < end), *[(begin <= at) & (at < end) for at in places.values()]])

    whole = (F.col("from_") >= low) & (F.col("from_") + F.col("rows_") <= high)
    opened = blocks.withColumn("open_", holds(F.col("from_"), F.col("from_") + F.col("rows_")))
    shut = opened.where(~F.col("open_") & whole).select(*groups, "sum_", F.col("rows_").alias("kept_"), *[F.lit(None).cast("double").alias(f"{a}_{s}_") for a, s in places])
    near = rows.join(opened.where("open_").select(*[F.col(g).alias(m) for g, m in zip(groups, names, strict=True)], F.col("block_").alias("b_")), same & (F.col("block_") == F.col("b_")), "left_semi")
    start = F.col("upto_") + F.coalesce(F.sum("k_").over(b.inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = near.withColumn("start_", start).withColumn("kept_", F.greatest(F.lit(0), F.least(F.col("start_") + F.col("k_"), high) - F.greatest("start_", low)))
    at = [F.when((F.col("start_") <= p) & (p < F.col("start_") + F.col("k_")), F.col("x_")).alias(f"{a}_{s}_") for (a, s), p in places.items()]
    parts = shut.unionByName(near.select(*groups, (F.col("kept_") * F.col("x_")).alias("sum_"), "kept_", *at))
    told = parts.groupBy(*groups).agg((F.sum("sum_") / F.sum("kept_")).alias("mean_"), *[F.max(f"{a}_{s}_").alias(f"{a}_{s}_") for a, s in places])
    out = told.join(sizes, same)
    between = [(F.col(f"{a}_lo_") + (F.col(f"{a}_hi_") - F.col(f"{a}_lo_")) * (place(p) - F.floor(place(p)))) for a, p in shares.items()]
    return out.select(*groups, n.alias("n"), F.round("mean_", 6).alias("trimmed_mean"), *[F.round(v, 6).alias(a) for v, a in zip(between, shares, strict=True)])


def trimmed_mean(df: DataFrame, value: str, groups: list[str], *, least: int = 10, share: float = 0.1) -> DataFrame:
    """groups, trimmed_mean: see order_statistics()."""
    return order_statistics(df, value, groups, least=least, cut=share).select(*groups, "trimmed_mean")


def paired_t(df: DataFrame, before: str, after: str, groups: list[str] | None = None) -> DataFrame:
    """n, mean_diff, t_stat of after - before; without spread t is 0 if the means are equal, else the limit 1e9 with its sign."""
    d = F.col(after).cast("double") - F.col(before).cast("double")
    m = df.groupBy(*(groups or [])).agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("s"))
    t = F.when(F.col("n") < 2, F.lit(0.0)).when(F.col("s") < 1e-12, F.signum("m") * 1e9).otherwise(F.col("m") / (F.when(F.col("s") < 1e-12, F.lit(1.0)).otherwise(F.col("s")) / F.sqrt(F.col("n").cast("double"))))
    return m.select(*(groups or []), "n", F.round("m", 6).alias("mean_diff"), F.round(t, 6).alias("t_stat"))


def proportion_z(df: DataFrame, success: Column, *, expected: float = 0.9) -> DataFrame:
    """n, share, z_stat of a share of successes against an expected one; 0 without rows."""
    m = df.agg(F.count("*").alias("n"), F.avg(success.cast("double")).alias("p"))
    z = (F.col("p") - expected) / F.sqrt(F.lit(expected * (1 - expected)) / F.greatest(F.col("n"), F.lit(1)))
    return m.select("n", F.round(F.coalesce("p", F.lit(0.0)), 6).alias("share"), F.round(F.coalesce(z, F.lit(0.0)), 6).alias("z_stat"))


def normal_below(z: float) -> float:
    """Standard normal distribution function."""
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def student_two_tailed(t: float, df: float) -> float:
    """Two-tailed p-value of a t statistic, from the regularised incomplete beta function."""
    if df <= 0:
        return 1.0
    return _beta(df / (df + t * t), df / 2, 0.5)


def _beta(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front / (a * _fraction(x, a, b))


def _fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function, from the tail backwards."""
    value = 1.0
    for k in range(200, 0, -1):
        m = k // 2
        term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1 + term / value
    return value


#: Rows of a group that one task resamples, and that one draw of a tree's leaf covers; powers of two.
BLOCK, LEAF = 4096, 64


def bootstrap_interval(df: DataFrame, value: str, groups: list[str], order: str, *, rounds: int = 500, seed: int = 42, least: int = 5, block: int = BLOCK) -> DataFrame:
    """Percentile bootstrap of group means: groups, n, low, high; null bounds under `least` rows.

    In each round a group of n rows is drawn from n times. How often each row is drawn is
    split down a binary tree over the rows in `order`: a node's draws fall left or right by
    a binomial of its own generator, known by seed, group and node; the draws of a leaf of
    64 rows fall by a multinomial. So the counts are those of sampling with replacement,
    for groups of every size alike, and do not depend on how rows are partitioned or
    blocked: a task gets `block` rows of a group, finds their draws along the path from
    the root, and tells one sum a round. `order` is distinct in a group. Null values and
    such as are not finite are left out.
    """
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(*groups, order, x.alias("x_"))
    names = [F.col(g).alias(f"g_{g}") for g in groups]
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"g_{g}")) for g in groups])
    sizes = rows.groupBy(*names).agg(F.count("*").alias("n"))
    placed = numbered(rows, groups, [order], "place_")
    dealt = placed.groupBy(*groups, F.floor((F.col("place_") - 1) / block).alias("block_")).agg(F.sort_array(F.collect_list(F.struct("place_", "x_"))).alias("rows_"))
    dealt = dealt.join(sizes.where(F.col("n") >= least), same).select(*groups, "n", "block_", F.xxhash64(F.lit(seed), *groups).alias("key_"), F.transform("rows_", lambda r: r["x_"]).alias("values_"))
    fields = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups)

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [drawn_sums(np.array(v.as_py()), b.as_py() * block, n.as_py(), k.as_py(), rounds, block) for v, b, n, k in zip(*(batch[c] for c in ("values_", "block_", "n", "key_")), strict=True)]
            told = pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch[g] for g in groups], batch["n"], told], names=[*groups, "n", "sums_"])

    sums = dealt.mapInArrow(resample, f"{fields}, n long, sums_ array<double>")
    means = sums.where(F.col("n") <= block).select(*groups, "n", F.transform("sums_", lambda s: s / F.col("n")).alias("means_"))
    large = sums.where(F.col("n") > block).select(*groups, "n", F.posexplode("sums_").alias("round_", "s_")).groupBy(*groups, "n", "round_").agg((F.sum("s_") / F.col("n")).alias("mean_"))
    means = means.unionByName(large.groupBy(*groups, "n").agg(F.collect_list("mean_").alias("means_")))
    ordered = F.sort_array("means_")
    bounds = means.select(*names, F.round(F.get(ordered, F.lit(int(0.025 * rounds))), 6).alias("low"), F.round(F.get(ordered, F.lit(min(rounds - 1, int(0.975 * rounds)))), 6).alias("high"))
    every = rows.groupBy(*groups).agg(F.count("*").alias("n"))
    return every.join(bounds, same, "left").select(*groups, "n", "low", "high")


def drawn_sums(values: np.ndarray, start: int, n: int, key: int, rounds: int, block: int) -> np.ndarray:
    """Sum of the values drawn in each round, of rows `start` and on of a group of n."""

    def node(at: int, size: int) -> np.random.Generator:
        return np.random.Generator(np.random.Philox(key=np.array([key & (1 << 64) - 1, at << 8 | size.bit_length()], np.uint64)))

    def left(at: int, size: int, count: np.ndarray) -> np.ndarray:
        half, rows = size // 2, min(size, n - at)
        return count if rows <= half else node(at, size).binomial(count, half / rows)

    at, size, count = 0, 1 << (n - 1).bit_length(), np.full(rounds, n)
    while size > block:
        to_left = left(at, size, count)
        size //= 2
        at, count = (at, to_left) if start < at + size else (at + size, count - to_left)
    total, open_ = np.zeros(rounds), [(at, size, count)]
    while open_:
        at, size, count = open_.pop()
        if size <= LEAF:
            some = values[at - start : at - start + size]
            total += node(at, size).multinomial(count, np.full(len(some), 1 / len(some))) @ some
        else:
            to_left, half = left(at, size, count), size // 2
            open_.append((at, half, to_left))
            if at + half < n:
                open_.append((at + half, half, count - to_left))
    return total
