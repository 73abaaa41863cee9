"""The ids of all N best segmentations, against every combination and against decoding."""

import hashlib
import itertools
import os

import numpy as np
import pytest

from scorewright.llm import sentencepiece_nbest as S
from tests.llm.cases import SCHEMA, corpus

pytestmark = pytest.mark.skipif(not os.path.exists(S.MODEL), reason="no vocabulary")


def test_each_segmentation_is_spliced_in():
    coder = S.Encoder(S.load(), 4)
    lat = coder.lattice
    score = lambda ids: sum(float(lat.score[i]) for i in ids)
    for text in ("the hewh of", "hewh", "the the the", "a b\nhewh the of and"):
        parts = [lat.nbest(p, 60) for p in S._PARTS.findall(" " + text)]
        sums = sorted((sum(p[i][0] for p, i in zip(parts, pick, strict=True)) for pick in itertools.product(*(range(min(6, len(p))) for p in parts))), reverse=True)[:4]
        ids, best, losses, exact, every = next(coder.encode([text]))
        assert exact and len(every) == len(losses) == len(sums) and every[0].tolist() == ids.tolist()
        assert len({tuple(x) for x in every}) == len(every)
        assert losses == pytest.approx([sums[0] - x for x in sums])
        assert [score(every[0]) - score(x) for x in every] == pytest.approx(losses)
        assert all(lat.decode(x) == text for x in every)


def test_every_segmentation_decodes(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA).select("doc_id", "text").unionByName(spark.createDataFrame([(900, " lead ▁ é́ \U0001f600 \x00\r\n\t"), (901, "x" * 300), (902, "▁▁"), (903, "")], "doc_id long, text string"))
    out = S.encode(docs)
    texts = out.selectExpr("doc_id", "ids_sha256", "losses", "nbest_sha256", "posexplode(nbest_ids) as (k, each)")
    back = S.decode(texts, ids_col="each").collect()
    allowed = {}
    for r in docs.collect():
        allowed.setdefault(r["doc_id"], set()).add(r["text"] or "")
    for r in back:
        assert r["text"] in allowed[r["doc_id"]]
        assert len(r["losses"]) == len(r["nbest_sha256"]) and r["nbest_sha256"][0] == r["ids_sha256"]
        assert r["nbest_sha256"][r["k"]] == hashlib.sha256(np.array(r["each"], "<i4").tobytes()).hexdigest()
    assert max(r["k"] for r in back) == 3


def test_parts_are_kept_between_tasks_and_those_met_often_when_there_are_many(monkeypatch):
    pieces = S.load()
    coder = S.encoder("one call", pieces, 4)
    assert S.encoder("one call", pieces, 4) is coder and S.encoder("another", pieces, 4) is not coder
    monkeypatch.setattr(S, "KEPT", 40)
    texts = [f"Some words stand in every text, {k * 7919} and some{k} in one." for k in range(60)] + ["", "naïve\n\n  ▁ and \U0001f600"]
    told = [[(g[0].tolist(), *g[1:4], [x.tolist() for x in g[4]]) for t in texts for g in c.encode([t])] for c in (coder,)][0]
    plain = [[(g[0].tolist(), *g[1:4], [x.tolist() for x in g[4]]) for g in S.Encoder(pieces, 4).encode([t])][0] for t in texts[::7]]
    assert told[::7] == plain
    assert len(coder.known) <= 60 and {" words", " every"} <= set(coder.known) and " some0" not in coder.known
