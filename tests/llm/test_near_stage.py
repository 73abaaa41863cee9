"""The pipeline's near-dedup stage against brute force on five-word sets."""

import random

import corpus_pipeline
from tests.llm.cases import LOWER, SCHEMA, components, corpus, words


def test_stage_links_on_five_words(spark):
    rng = random.Random(9)
    rows = [r for r in corpus() if r[0] is not None]
    ids = [r[0] for r in rows]
    rows = [r for r in rows if ids.count(r[0]) == 1]
    base = [f"k{i}" for i in range(200)]
    spread = list(base)
    for i in (20, 60, 100, 140, 180):
        spread[i] = "zz"
    near = list(base)
    near[50] = near[150] = "yy"
    extra = [(1000, " ".join(base)), (1001, " ".join(spread)), (1002, " ".join(near))]
    for k in range(12):
        copy = list(base)
        for i in rng.sample(range(200), k):
            copy[i] = f"n{k}"
        extra.append((2000 + k, " ".join(copy)))
    rows += [(d, t, "en", "s", len(t), *rows[0][5:]) for d, t in extra]
    sets = []
    for r in rows:
        w = words(r[1] and r[1].translate(LOWER))
        sets.append((r[0], frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    label = components({d for d, _ in sets}, links)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert got == {d for d, _ in sets if label[d] == d}


def test_repeated_and_null_ids_lose_no_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(20, a), (24, a), (24, b), (30, b), (None, c), (None, c), (7, c + " more"), (30, b)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == [(7, c + " more"), (20, a), (24, b)]


def test_five_spread_edits_are_no_near_copy(spark):
    base = [f"k{i}" for i in range(200)]
    spread = ["zz" if i in (20, 60, 100, 140, 180) else w for i, w in enumerate(base)]
    docs = spark.createDataFrame([(d, " ".join(t), "en", "s", 1) for d, t in ((1, base), (2, spread))], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {1, 2}
