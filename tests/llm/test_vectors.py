"""Neighbours and clusters of vectors against plain brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.llm import hamerly as H
from scorewright.llm import posting_lists as P

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vec string, list int, q string, cls long, score string, rank string, x string, cluster string"


def table(spark, rows):
    extra = (7, 1, "clash", 2, None, 3, "s", None, "x", "c")
    return spark.createDataFrame([(i, v, *extra) for i, v in rows], SCHEMA)


def groups(seed: int, n: int, width: int, centres: int = 12, spread: float = 0.15) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(centres, width))[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, width))).astype(np.float32)


def brute(rows: list[tuple[int, list[float]]], asks, top: int = 10) -> dict:
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for i, v in rows:
        if asks(i):
            d = np.sqrt(((x - np.array(v, np.float64)) ** 2).sum(1))
            out[i] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != i][:top]
    return out


def told(df) -> dict:
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("spread", [0.15, 3.0])
def test_recall_against_brute_force(spark, spread):
    x = groups(3, 3000, 16, spread=spread)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = told(P.neighbours(table(spark, rows), F.col("vec_id") % 20 == 0)), brute(rows, lambda i: i % 20 == 0)
    assert set(got) == set(want)
    assert sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want) >= 0.9 * sum(map(len, want.values()))
    where = {i: np.array(v, np.float64) for i, v in rows}
    for i, found in got.items():
        assert len(found) == 10 and all(d == pytest.approx(math.dist(where[i], where[j]), abs=1e-12) for j, d in found)
        assert found == sorted(found, key=lambda r: (r[1], r[0]))


def test_blocks_of_lists_lose_nothing(spark, monkeypatch):
    """Lists and searches cut into small blocks give what whole ones give."""
    rows = [(i, v.tolist()) for i, v in enumerate(groups(4, 700, 8))]
    run = lambda: told(P.neighbours(table(spark, rows), F.col("vec_id") % 5 == 0))
    whole = run()
    monkeypatch.setattr(P, "BLOCK_COMPONENTS", 8 * 16)
    assert run() == whole


def test_copies_ties_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100 + i, [0.0, float(i)]) for i in range(1, 6)] + [(200, [1.0, 0.5]), (300, [3.0, 3.0])]
    bad = [(400, None), (500, []), (600, [0.0, 0.0]), (700, [1.0, None]), (800, [nan, 1.0]), (900, [inf, 1.0]), (None, [1.0, 0.0])]
    got = told(P.neighbours(table(spark, rows + bad + rows[:3]), F.col("vec_id") % 100 == 0))
    assert got == brute(rows, lambda i: i % 100 == 0)
    # vectors of another width are searched for among themselves, and few candidates are all returned
    few = [(0, [1.0]), (1, [2.0]), (2, [4.0]), (100, [1.0, 1.0, 1.0])]
    assert told(P.neighbours(table(spark, few), F.col("vec_id") % 100 == 0)) == {0: [(1, 1.0), (2, 3.0)]}
    assert P.neighbours(table(spark, []), F.col("vec_id") % 100 == 0).collect() == []
    assert P.neighbours(table(spark, bad), F.col("vec_id") % 100 == 0).collect() == []
    # of rows with one id the lesser vector stands
    twice = [(0, [1.0, 1.0]), (1, [5.0, 0.0]), (1, [2.0, 0.0])]
    assert told(P.neighbours(table(spark, twice), F.col("vec_id") == 0)) == {0: [(1, math.sqrt(2))]}


def test_walk_finds_the_nearest_centroids():
    x = groups(5, 4000, 24, centres=40, spread=0.6).astype(np.float64)
    m = P.fit(x, 200)
    assert m.share.max() < 4 / 200 and m.share.sum() == pytest.approx(1)
    ids, d = P.walked(x[:300], m, 32)
    exact = np.sort(np.sqrt(((x[:300, None] - m.centroids[None]) ** 2).sum(2)), axis=1)
    assert (np.abs(d[:, 0] - exact[:, 0]) < 1e-9).mean() > 0.98
    assert all(len(set(r.tolist())) == len(r) for r in ids)


def plain_clusters(rows, k: int, rounds: int, dimensions: int, seed: int = 2, scale: int = 256):
    """Every distance in every round, in Python's integers."""
    good = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and len(v) == dimensions and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted((r for r in good if r[0] is not None), key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in order[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    near = lambda v: min((far(v, m), j) for j, m in enumerate(c))
    if not c:
        return []
    for _ in range(rounds):
        which = [near(v)[1] for _, v in good]
        for j in range(len(c)):
            own = [v for (_, v), w in zip(good, which, strict=True) if w == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [(i, *near(v)[::-1]) for i, v in good]
    total: dict = {}
    for _, j, d in last:
        total[j] = total.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, d, total[j], sum(total.values()), digest[j]) for i, j, d in last), key=repr)


@pytest.mark.parametrize("kind", ["spread", "groups", "ties", "large", "few", "one"])
def test_clusters_against_plain_integers(spark, kind):
    rng = random.Random(8)
    row = lambda f: [f() for _ in range(6)]
    rows = {
        "spread": [(i, row(lambda: rng.gauss(0, 1))) for i in range(300)],
        "groups": [(i, v.tolist()) for i, v in enumerate(groups(6, 400, 6, spread=0.05))],
        "ties": [(i, row(lambda: float(rng.randint(-1, 1)))) for i in range(200)],
        "large": [(i, row(lambda: rng.choice((1.0, -3.5, 2.0**20, -(2.0**21))))) for i in range(60)],
        "few": [(i, row(lambda: rng.gauss(0, 1))) for i in range(5)],
        "one": [(4, [0.5] * 6)] * 3,
    }[kind]
    nan, inf = float("nan"), float("inf")
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 7), (904, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (905, [nan] * 6), (906, [inf] + [1.0] * 5), (None, [0.25] * 6), rows[0]]
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    df = H.clusters(table(spark, rows).repartition(3), k=12, rounds=5, dimensions=6)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect()), key=repr) == plain_clusters(rows, 12, 5, 6)


def test_clusters_without_vectors_and_beyond_longs(spark):
    assert H.clusters(table(spark, [])).collect() == []
    assert H.clusters(table(spark, [(None, [1.0] * 64)])).collect() == []
    got = H.clusters(table(spark, [(1, [3e38] * 4), (2, [-3e38] * 4), (3, [0.0] * 4)]), k=1, dimensions=4).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3} and {r["inertia"] for r in got} == {H.LONGEST}


def test_bounds_save_scans_and_change_nothing():
    x = np.floor(256 * groups(7, 3000, 16, centres=8, spread=0.05).astype(np.float64)).astype(np.int64)
    c = x[np.random.default_rng(1).choice(len(x), 8, replace=False)]
    state, scans = H.nearest(x, c), []
    for _ in range(6):
        total = [x[state[0] == j] for j in range(len(c))]
        after = np.array([t.sum(0) // len(t) if len(t) else m for t, m in zip(total, c, strict=True)])
        *state, n = H.moved(x, *state, c, after)
        scans.append(n)
        d = ((x[:, None] - after[None]) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()
        rest = np.sort(np.sqrt(d), axis=1)
        assert (state[1] >= rest[:, 0] * (1 - 1e-9)).all() and (state[2] <= rest[:, 1] * (1 + 1e-9)).all()
        c = after
    assert scans[-1] < len(x) / 10
