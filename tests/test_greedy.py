"""Greedy dedupe in few rounds, however long rows wait for each other."""

import random

import pytest

from scorewright.operators import dedupe
from scorewright.sources.tables import keeper


def fold(rows) -> dict:
    taken: tuple[set, set] = (set(), set())
    out = {}
    for i, a, b, ok in sorted(rows):
        out[i] = bool(ok) and a not in taken[0] and b not in taken[1]
        if out[i]:
            taken[0].update({a} - {None})
            taken[1].update({b} - {None})
    return out


def run(spark, rows) -> tuple[dict, int]:
    keep, kept = keeper(spark, "greedy"), []
    df = spark.createDataFrame(rows, "i int, a string, b string, ok boolean").repartition(3)
    got = dedupe.greedy_dedupe(df, ["a", "b"], "i", "ok", lambda x: kept.append(1) or keep(x))
    return {r["i"]: r["included"] for r in got.collect()}, len(kept)


def test_a_chain_of_ten_thousand_links(spark):
    """Row i shares one key with row i - 1 and the other with row i + 1."""
    rows = [(i, f"a{(i + 1) // 2}", f"b{i // 2}", True) for i in range(10_000)]
    got, tables = run(spark, rows)
    assert got == fold(rows) and sum(got.values()) == 5000
    assert tables < 30


@pytest.mark.parametrize("seed", range(3))
def test_against_a_fold(spark, seed):
    rng = random.Random(seed)
    n = (12, 40, 90)[seed]
    pick = lambda p: None if rng.random() < 0.1 else f"{p}{rng.randint(0, n)}"
    rows = [(i, pick("a"), pick("b"), rng.random() < 0.9) for i in range(120)]
    # chains with a few rows that join them
    rows += [(200 + i, f"c{(i + 1) // 2}", f"d{i // 2}", True) for i in range(60)] + [(300 + i, f"c{rng.randint(0, 30)}", f"d{rng.randint(0, 30)}", True) for i in range(20)]
    assert run(spark, rows)[0] == fold(rows)


def test_a_common_key_and_no_rows(spark):
    rows = [(i, "same", f"b{i % 50}", True) for i in range(400)]
    got, tables = run(spark, rows)
    assert got == fold(rows) and tables < 12
    assert run(spark, [(1, "a", "b", False), (2, "a", "b", None)])[0] == {1: False, 2: False}
