"""Prefixes in two levels against plain loops, over blocks of a few rows."""

import math
import random
from statistics import fmean

import pytest
from pyspark.sql import functions as F

from scorewright.operators import context, ranking, stats
from scorewright.operators.scan import Blocks, added, carried, numbered


@pytest.fixture
def cut_small(spark):
    """Ranges of few rows: many blocks, also within one group."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def paragraphs(seed: int = 1):
    rng = random.Random(seed)
    rows = [(d, i, rng.choice((None, None, None, f"s{rng.randint(0, 9)}")), rng.randint(0, 2) * rng.randint(0, 2), rng.randint(1, 30), rng.randint(1, 90)) for d, n in (("long", 200), ("b", 7), (None, 5), ("one", 1)) for i in range(n)]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc string, place int, section string, hits int, tokens int, chars int"


def by_doc(rows):
    out: dict = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_a_group_spans_blocks(spark, cut_small):
    b = Blocks(spark.createDataFrame(paragraphs(), SCHEMA), ["doc"], ["place"])
    assert b.rows.where("doc = 'long'").select("block_").distinct().count() > 3
    sums = {(r["doc"], r["block_"]): r["s_"] for r in b.with_before(s_=added(F.sum("tokens")), last_=carried(F.max_by("section", F.when(F.col("section").isNotNull(), F.col("nth_"))))).collect()}
    parts = {(r["doc"], r["block_"]): r["t"] for r in b.rows.groupBy("doc", "block_").agg(F.sum("tokens").alias("t")).collect()}
    assert sums == {(d, k): sum(t for (e, j), t in parts.items() if e == d and j < k) or None for d, k in parts}


def test_numbers_in_groups(spark, cut_small):
    df = spark.createDataFrame(paragraphs(), SCHEMA)
    got = {(r["doc"], r["place"]): r["n"] for r in numbered(df, ["doc"], [F.desc("place")], "n").collect()}
    assert got == {(d, r[1]): len(rows) - i for d, rows in by_doc(paragraphs()).items() for i, r in enumerate(rows)}
    every = [r["n"] for r in numbered(df, [], ["doc", "place"], "n").orderBy("doc", "place").collect()]
    assert every == list(range(1, len(every) + 1))


def test_context_of_long_documents(spark, cut_small):
    rows = paragraphs(2)
    df = spark.createDataFrame(rows, SCHEMA)
    sections = {(r["doc"], r["place"]): r["now"] for r in context.carried_forward(df, "doc", "place", F.col("section"), "now").collect()}
    chosen = {(r["doc"], r["place"]): r["selection"] for r in context.with_neighbors(df, "doc", "place", F.col("hits")).collect()}
    kept = {(r["doc"], r["place"]): r["running_estimate"] for r in context.budget_prefix(df, "doc", "place", "tokens", "chars", 700, header_tokens=20, header_chars=80).collect()}
    want: tuple[dict, dict, dict] = ({}, {}, {})
    for d, part in by_doc(rows).items():
        now, tokens, chars = "Unknown", 20, 80
        for i, (_, place, section, hits, t, c) in enumerate(part):
            now, tokens, chars = section or now, tokens + t, chars + c
            want[0][d, place] = now
            beside = any(part[j][3] > 0 for j in (i - 1, i + 1) if 0 <= j < len(part))
            want[1][d, place] = 100 + hits if hits else 30 if beside else None
            if i == 0 or max(tokens, -(-chars // 4)) <= 700:
                want[2][d, place] = max(tokens, -(-chars // 4))
    assert (sections, chosen, kept) == want


@pytest.mark.parametrize("rounding", ["ceil", "even"])
def test_edges_and_ranks_with_a_common_value(spark, cut_small, rounding):
    rng = random.Random(5)
    rows = [(g, i, rng.choice((1.0, 2.0, 2.0, 2.0, 2.0, 3.0)) if n > 3 else 2.0) for g, n in (("x", 150), ("y", 11), ("z", 3), ("w", 1)) for i in range(n)]
    df = spark.createDataFrame([*rows, ("x", 999, None)], "g string, id int, v double")
    got = {(r["g"], r["id"]): (r["in_top"], r["in_bottom"], r["edge_size"]) for r in ranking.edge_flags(df, "v", "id", groups=["g"], rounding=rounding).collect()}
    ranks = {(r["g"], r["id"]): r["rank"] for r in ranking.ordinal_rank(df, "v", [F.col("id")], groups=["g"]).collect()}
    want, places = {}, {}
    for g in "xyzw":
        own = [r for r in rows if r[0] == g]
        size = max(1, -(-len(own) // 5) if rounding == "ceil" else round(len(own) * 0.2))
        top = {r[1] for r in sorted(own, key=lambda r: (-r[2], -r[1]))[:size]}
        bottom = {r[1] for r in sorted(own, key=lambda r: (r[2], r[1]))[:size]}
        want |= {(g, r[1]): (r[1] in top, r[1] in bottom, size) for r in own}
        places |= {(g, r[1]): i for i, r in enumerate(sorted(own, key=lambda r: (-r[2], r[1])), 1)}
    assert got == want and ranks == places


def test_trimmed_means_of_large_and_small_groups(spark, cut_small):
    rng = random.Random(6)
    rows = [(g, float(rng.randint(0, k)) if k else 3.0) for g, n, k in (("x", 400, 1000), ("ties", 300, 3), ("y", 10, 5), ("nine", 9, 50), ("same", 40, 0), (None, 25, 9)) for _ in range(n)]
    df = spark.createDataFrame([*rows, ("x", None)], "g string, v double")
    got = {r["g"]: r["trimmed_mean"] for r in stats.trimmed_mean(df, "v", ["g"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted(v for k, v in rows if k == g)
        cut = max(1, int(0.1 * len(own))) if len(own) >= 10 else 0
        want[g] = round(fmean(own[cut : len(own) - cut]), 6)
    assert got == pytest.approx(want)
    found = stats.order_statistics(df, "v", ["g"], shares={"p25": 0.25, "half": 0.5, "p99": 0.99, "least": 0.0, "most": 1.0}, least=12, cut=0.3).collect()
    for r in found:
        own = sorted(v for k, v in rows if k == r["g"])
        at = lambda p: (lambda t: own[math.floor(t)] + (own[math.ceil(t)] - own[math.floor(t)]) * (t - math.floor(t)))((len(own) - 1) * p)  # noqa: E731, B023
        cut = int(0.3 * len(own)) if len(own) >= 12 else 0
        assert [r["n"], r["trimmed_mean"], r["p25"], r["half"], r["p99"], r["least"], r["most"]] == pytest.approx([len(own), fmean(own[cut : len(own) - cut]), at(0.25), at(0.5), at(0.99), own[0], own[-1]], abs=1e-6)
    assert {r["g"] for r in found} == set(want)
