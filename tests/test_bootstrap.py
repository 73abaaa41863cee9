"""The bootstrap is one for groups of every size, whatever the blocks and partitions."""

import random
from statistics import fmean, pstdev

import numpy as np
import pytest

from scorewright.operators import stats


def run(df, **options):
    return {r["g"]: (r["n"], r["low"], r["high"]) for r in stats.bootstrap_interval(df, "v", ["g"], "o", **options).collect()}


def test_blocks_and_partitions_change_nothing(spark):
    rng = random.Random(6)
    x = [rng.uniform(0, 10) for _ in range(1500)]
    rows = [(None, i, v) for i, v in enumerate(x)] + [("s", i, float(i)) for i in range(70)] + [("few", i, float(i % 3)) for i in range(5)] + [("t", 1, 2.0), ("t", 2, None), ("n", 1, float("nan"))]
    df = spark.createDataFrame(rows, "g string, o int, v double")
    got = run(df)
    assert got == run(df.repartition(5)) == run(df, block=64) == run(df, block=256)
    assert got["t"] == (1, None, None) and set(got) == {None, "s", "few", "t"}
    half = 1.96 * pstdev(x) / len(x) ** 0.5
    assert got[None] == (1500, pytest.approx(fmean(x) - half, abs=0.2 * half), pytest.approx(fmean(x) + half, abs=0.2 * half))
    assert run(df, seed=7)[None] != got[None]


def plain_counts(n: int, key: int, rounds: int) -> np.ndarray:
    """How often each row is drawn: the whole tree, node by node."""
    out = np.zeros((rounds, n), np.int64)

    def go(at: int, size: int, count) -> None:
        rows = min(size, n - at)
        if rows <= 0:
            return
        draw = np.random.Generator(np.random.Philox(key=np.array([key & (1 << 64) - 1, at << 8 | size.bit_length()], np.uint64)))
        if size <= stats.LEAF:
            out[:, at : at + rows] = draw.multinomial(count, [1 / rows] * rows)
        elif rows <= size // 2:
            go(at, size // 2, count)
        else:
            one = draw.binomial(count, size // 2 / rows)
            go(at, size // 2, one)
            go(at + size // 2, size // 2, count - one)

    go(0, 1 << (n - 1).bit_length(), np.full(rounds, n))
    return out


@pytest.mark.parametrize("n,block", [(1, 64), (5, 64), (64, 64), (65, 64), (1000, 64), (1000, 256), (5000, 4096)])
def test_sums_of_blocks_against_the_whole_tree(n, block):
    x, key, rounds = np.random.default_rng(n).normal(size=n), -7 * n, 40
    counts = plain_counts(n, key, rounds)
    assert (counts.sum(axis=1) == n).all()
    parts = sum(stats.drawn_sums(x[lo : lo + block], lo, n, key, rounds, block) for lo in range(0, n, block))
    assert parts == pytest.approx(counts @ x)


def test_counts_are_those_of_drawing_with_replacement():
    n, rounds = 300, 4000
    counts = plain_counts(n, 99, rounds)
    assert counts.mean() == 1 and abs(counts.var() - (1 - 1 / n)) < 0.01
    # neighbours in a leaf, across leaves and across halves
    for a, b in ((0, 1), (63, 64), (10, 290)):
        assert abs(np.cov(counts[:, a], counts[:, b])[0, 1] + 1 / n) < 0.06
