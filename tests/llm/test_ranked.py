"""Ranked search against a plain loop over items and documents."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from scorewright.llm import impact_search as S
from scorewright.llm import rolling as R
from tests.llm.cases import LOWER, SCHEMA, corpus

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=20):
    held = [(i, terms(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df: dict = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    wanted: dict = {}
    for i, t in sorted({r for r in items if r[0] is not None}, key=repr):
        wanted.setdefault(i, []).extend(terms(t))
    out = []
    for i, ws in wanted.items():
        scores = []
        for d, w in held:
            if d is not None and w:
                m = 75 + 25 * len(w) * n // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 12 * m)) for t in ws if t in df)
                if s > 0:
                    scores.append((-s, d))
        out += [(i, k, d, -s) for k, (s, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


ITEMS = [(1, "W1 w2 the of"), (2, "of of of w7"), (3, "nothing-that-is-there"), (4, None), (5, ""), (6, "naïve ÉTÉ été"), (7, "w3"), (7, "w3"), (7, "w4 w3"), (None, "w1"), (8, " ".join(f"w{i}" for i in range(400)))]


@pytest.mark.parametrize("block", [1 << 20, 8])
def test_against_a_plain_loop(spark, block, monkeypatch):
    monkeypatch.setattr(S, "ENTRIES", 500)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    items = spark.createDataFrame([(i, t, 3, "clash") for i, t in ITEMS], "item_id long, text string, rank int, term string")
    got = sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in S.ranked(docs, items, block_pairs=block).collect())
    assert got == plain([r[:2] for r in rows], ITEMS)


def test_empty_tables_and_texts(spark):
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    items = lambda rows: spark.createDataFrame(rows, "item_id long, text string")
    for d, i in (([], [(1, "a")]), ([(1, "a")], []), ([(1, None), (2, ""), (3, " .-")], [(1, "a")]), ([(1, "a")], [(1, None)]), ([(1, "a")], [(1, "b")])):
        assert S.ranked(docs(d), items(i)).collect() == []
    ties = S.ranked(docs([(i, "same words") for i in range(30)] + [(99, "other")]), items([(1, "words")])).collect()
    assert [(r["rank"], r["doc_id"]) for r in sorted(ties, key=lambda r: r["rank"])] == [(i + 1, i) for i in range(20)]


def test_long_texts_are_read_in_parts():
    rng = random.Random(3)
    body = " ".join(rng.choice(("alpha", "beta", "gamma")) for _ in range(600_000)) + " " + "x" * (3 * R.CHUNK_BYTES) + " alpha"
    v = S.Vocabulary.of([(1, "alpha", 1), (1, "gamma", 2), (2, "delta", 1)])
    (lo, length, row, term, n), = S.matched(pa.array([body]), v)
    words = terms(body)
    assert (lo, length.tolist(), row.tolist()) == (0, [len(words)], [0, 0])
    assert sorted(n.tolist()) == sorted([words.count("alpha"), words.count("gamma")])


def test_sums_of_packed_keys():
    rng = np.random.default_rng(2)
    for items, docs, n in ((3, 5, 200), (1000, 70_000, 5000), (1, 1, 4), (2, 3, 0)):
        item, doc, gain = rng.integers(0, items, n), rng.integers(0, docs, n), rng.integers(0, 1 << 40, n)
        want: dict = {}
        for i, d, g in zip(item.tolist(), doc.tolist(), gain.tolist(), strict=True):
            want[i, d] = want.get((i, d), 0) + g
        i, d, s = S.accumulated(item, doc, gain, docs)
        assert list(zip(zip(i.tolist(), d.tolist(), strict=True), s.tolist(), strict=True)) == sorted(want.items())
