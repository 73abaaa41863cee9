"""Blocks of runs and of buckets, at sizes where there are many of them."""

import numpy as np
import pytest

from scorewright.llm import imatch, minhash


@pytest.mark.parametrize("ids", [list(range(0, 4000, 7)), [*range(50), *range(10**12, 10**12 + 50)], [None, None, 3, 3, 3, 9, 2, 2]])
def test_next_rows_over_many_blocks_of_runs(spark, monkeypatch, ids):
    monkeypatch.setattr(imatch, "RUN", 2)
    monkeypatch.setattr(imatch, "RUN_BLOCK", 3)
    monkeypatch.setattr(imatch, "RUNS_A_TASK", 1)
    rows = [(d, f"t{k}") for k, d in enumerate(ids)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = imatch.with_next(docs, "id", ["text"], lambda df: df, ["text"]).select("id", "text", "next_text")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = [(d, t, order[(k + 1) % len(order)][1]) for k, (d, t) in enumerate(order)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_pairs_with_a_band_that_only_seems_shared_are_told():
    same = np.zeros((4, 12), bool)  # 4 bands of 3
    same[0, 6:9] = True  # shares band 2 alone
    same[1, 0:3] = same[1, 6:9] = True  # seems to share band 0 too
    same[2, 0:9] = True  # two before it
    same[3, 9:12] = same[3, 6:9] = True  # another after it
    assert minhash._counts_here(same, 3, 2).tolist() == [True, True, False, True]
    assert minhash._counts_here(same, 3, 0).all()
    assert minhash._counts_here(same[:0], 3, 2).tolist() == []
