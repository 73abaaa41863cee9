"""The whole pipeline against its rules, carried out one after another in plain Python."""

import os
import random
from collections import Counter

import pytest
import regex

import corpus_pipeline
from scorewright.llm import sentencepiece_nbest
from tests.llm.cases import LOWER, SCHEMA, components, corpus, words
from tests.llm.test_dedup import removed
from tests.llm.test_overlap_masks import aligned

pytestmark = pytest.mark.skipif(not os.path.exists(sentencepiece_nbest.MODEL), reason="no vocabulary")


def tokens(text: str) -> list[str]:
    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


def plainly(docs: dict[int, str], items: list[str]) -> tuple[dict[int, str], list[int]]:
    """Texts that are left, and how many documents each stage leaves."""
    left, sizes = {d: t for d, t in docs.items() if t and regex.search(r"\p{L}", t)}, []
    sizes.append(len(left))
    sets = {}
    for d, t in left.items():
        w = words(t.translate(LOWER))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = components(ids, links)
    left = {d: t for d, t in left.items() if label[d] == d}
    sizes.append(len(left))
    split = {d: words(t) for d, t in left.items()}
    gone = dict(zip(split, removed(list(split.values()), 35), strict=True))
    left = {d: " ".join(w for w, g in zip(split[d], gone[d], strict=True) if not g) if any(gone[d]) else left[d] for d in left}
    left = {d: t for d, t in left.items() if not all(gone[d]) and split[d]}
    sizes.append(len(left))
    left = {d: t for d, t in left.items() if not any(aligned(tokens(t), i) for i in map(tokens, items) if len(i) >= 5)}
    sizes.append(len(left))
    return left, sizes


def test_run_against_plain_rules(spark, tmp_path):
    rng = random.Random(12)
    rows = [r for r in corpus(seed=8, n=50) if r[0] is not None]
    often = Counter(r[0] for r in rows)
    docs = {r[0]: r[1] for r in rows if often[r[0]] == 1}
    noise = lambda n: " ".join(f"n{rng.randint(0, 10**6)}" for _ in range(n))
    items = ["A question on the capital of some old country, which no one recalls today?", "short one", "five words stand here whole", ""]
    swapped = items[0].replace("old", "new").replace("recalls", "knows")
    docs |= {1000: f"{noise(20)} {items[0]} {noise(9)}", 1001: f"{noise(3)} {swapped}", 1002: f"{noise(30)} short one {noise(3)}", 1003: f"so five words stand here whole, {noise(5)}", 1004: "12 34 5 !", 1005: noise(400), 1006: f"{noise(40)}\n{docs[7][2000:3200]}", 1007: " ".join(docs[7].split()[:1200] + ["zz"])}
    table = [(d, t, "en" if d % 3 else None, "s", None if t is None else len(t), *rows[0][5:]) for d, t in docs.items()]
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want, sizes = plainly(docs, items)
    assert len({len(docs), *sizes}) >= 4 and 1002 in want and not {1000, 1001, 1003, 1004} & set(want)
    out = sentencepiece_nbest.decode(corpus_pipeline.run(spark, str(tmp_path)))
    got = {r["doc_id"]: (r["text"], r["exact"]) for r in out.collect()}
    assert got == {d: (t, True) for d, t in want.items()}
