"""Decontamination, fingerprints, language models, tokens, rollups and classifiers."""

import hashlib
import math
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scorewright.llm import decontaminate, imatch, langid, lm_score, sentencepiece_nbest, token_rollup, toxicity
from tests.llm.cases import SCHEMA, corpus, words

DATA = "/root/testdata/sf0.01"
have_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
have_pieces = pytest.mark.skipif(not os.path.exists(sentencepiece_nbest.MODEL), reason="no vocabulary")


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_overlaps_stand_substitutions(spark):
    rng = random.Random(4)
    item = [f"q{i}" for i in range(30)]
    noise = lambda n: [f"z{rng.randint(0, 9999)}" for _ in range(n)]
    swapped = [w if i % 7 else "zz" for i, w in enumerate(item)]
    half = item[:15]
    far = [w if i % 2 else "zz" for i, w in enumerate(item)]
    texts = [(1, noise(40) + item + noise(5)), (2, noise(9) + swapped), (3, noise(3) + half + noise(50)), (4, noise(80)), (5, far), (6, item[:6]), (None, item), (7, [w.upper() + "," for w in item])]
    docs = spark.createDataFrame([(d, " ".join(t), "x") for d, t in texts] + [(8, None, "x"), (9, "", "x")], "doc_id long, text string, d string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, "too short"), (12, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_equal"] for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == {(1, 10): 30, (2, 10): 25, (3, 10): 15, (None, 10): 30, (7, 10): 30}
    kept = {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert kept == {4, 5, 6, 8, 9}
    assert decontaminate.overlaps(docs.limit(0), bench).count() == decontaminate.overlaps(docs, bench.limit(0)).count() == 0


def test_fingerprints(docs, rows):
    got = imatch.fingerprints(docs, least=0.01, most=0.9).collect()
    assert len(got) == len(rows)
    by_text = defaultdict(set)
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        h = len(t) // 2
        want[(d, len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    texts = defaultdict(set)
    for d, t in order:
        texts[d].add(t)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if len(texts[r["doc_id"]]) == 1:
            by_text[next(iter(texts[r["doc_id"]]))].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprints_of_few_rows(spark):
    one = imatch.fingerprints(spark.createDataFrame([(5, "solo text")], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0
    assert imatch.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 9000, "bucket_bytes": 12000}])
def test_language_model_against_plain_counts(spark, docs, rows, sizes):
    good = {r[0] for r in rows if r[0] is not None and r[0] % 2 == 0}
    labels = spark.createDataFrame([(d, 1, "x") for d in sorted(good)] + [(None, 1, "x"), (101, 0, "x"), (102, None, "x")], "doc_id long, quality int, id string")
    got = lm_score.cross_entropy_difference(docs, labels, **sizes).collect()
    assert len(got) == len(rows)
    low = {i: i + 32 for i in range(65, 91)}
    seqs = [(r[0], words((r[1] or "").translate(low))) for r in rows]
    vocabulary = {w for _, s in seqs for w in s}
    models = []
    for pick in (lambda d: d in good, lambda d: True):
        w, p, ctx = Counter(), Counter(), Counter()
        for d, s in seqs:
            if pick(d):
                for a, b in zip(["^", *s], s, strict=False):
                    w[b] += 1
                    p[a, b] += 1
                    ctx[a] += 1
                ctx.update(s[-1:])  # the text's end follows
        models.append((w, p, ctx))

    def loss(m, s):
        w, p, ctx = m
        total, size = sum(w.values()), len(vocabulary) + 1
        out = 0.0
        for a, b in zip(["^", *s], s, strict=False):
            first = (w[b] + 1) / (total + size)
            out -= math.log((p[a, b] + lm_score.STRENGTH * first) / (ctx[a] + lm_score.STRENGTH))
        return out / len(s)

    want = Counter((d, len(s), round(loss(models[0], s) - loss(models[1], s), 6) if s else None) for d, s in seqs)
    assert Counter((r["doc_id"], r["n_tokens"], None if r["difference"] is None else round(r["difference"], 6)) for r in got) == want


def test_language_model_of_no_rows(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert lm_score.cross_entropy_difference(docs.limit(0), labels).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert {tuple(r) for r in lm_score.cross_entropy_difference(blank, labels).collect()} == {(1, 0, None, None, None), (2, 0, None, None, None)}


@have_pieces
def test_segmentations_against_all_of_them():
    lat = sentencepiece_nbest.Lattice(sentencepiece_nbest.load())

    def every(part, i=0):
        if i == len(part):
            yield 0.0, ()
        for j in range(i + 1, min(len(part), i + lat.longest) + 1):
            piece = lat.id.get(part[i:j])
            if piece is not None or j == i + 1:
                for s, rest in every(part, j):
                    yield s + (float(lat.score[piece]) if piece is not None else lat.fallback), (piece if piece is not None else -2 - ord(part[i]), *rest)

    for part in (" the", " hewh", "  xé▁☃", "\n", " a"):
        want = sorted((s for s, _ in every(part)), reverse=True)[:4]
        assert [s for s, _ in lat.nbest(part, 4)] == want
        path, gap, best = lat.side_by_side([part], len(part))
        assert best[0] == want[0] and gap[0] == (want[0] - want[1] if len(want) > 1 else math.inf)


@have_pieces
def test_encoding_round_trip(spark, docs, rows):
    odd = spark.createDataFrame([(900, " lead ▁ é́ \U0001f600 \x00\r\n\t"), (901, "x" * 5000), (902, "▁▁")], "doc_id long, text string")
    all_ = docs.select("doc_id", "text").unionByName(odd)
    got = sentencepiece_nbest.encode(all_)
    assert got.where("not exact").count() == 0
    back = Counter((r["doc_id"], r["text"]) for r in sentencepiece_nbest.decode(got).collect())
    assert back == Counter((r["doc_id"], r["text"] or "") for r in all_.collect())
    for r in got.collect():
        assert r["losses"] == sorted(r["losses"]) and r["losses"][0] == 0 and r["n_pieces"] == len(r["ids"])
    assert sentencepiece_nbest.encode(all_.limit(0)).count() == 0


@have_pieces
def test_ties_of_long_runs_end():
    import time

    coder = sentencepiece_nbest.Encoder(sentencepiece_nbest.load(), 4)
    began = time.time()
    for text in ("x" * 100_000, "=" * 20_001, "ab" * 5_000 + " " * 9_000, "\n" * 3_000):
        ids, score, losses, exact, every = next(coder.encode([text]))
        assert exact and losses == sorted(losses) and len({tuple(e) for e in every}) == len(every)
    assert time.time() - began < 60


@have_pieces
def test_nbest_of_a_text_against_all_combinations():
    coder = sentencepiece_nbest.Encoder(sentencepiece_nbest.load(), 4)
    lat = coder.lattice
    text = "the hewh of"
    parts = [lat.nbest(p, 50) for p in (" the", " hewh", " of")]
    sums = sorted(sum(x[0][0] - x[i][0] for x, i in zip(parts, pick, strict=True)) for pick in [(a, b, c) for a in range(len(parts[0])) for b in range(len(parts[1])) for c in range(len(parts[2]))])
    assert next(coder.encode([text]))[2] == sums[:4]


@have_pieces
def test_tied_best_against_all_of_them():
    lat = sentencepiece_nbest.Lattice(sentencepiece_nbest.load())
    into = lat._edges("xxxxxxxxxxxx")
    best = [[0.0]] + [[] for _ in range(12)]
    for j in range(1, 13):
        best[j] = sorted((x + s for i, _, s in into[j] for x in best[i]), reverse=True)
    got = lat.nbest("xxxxxxxxxxxx", 9)
    assert [x for x, _ in got] == best[12][:9] and len({p for _, p in got}) == 9


def test_rollup_commits(spark, tmp_path):
    r = token_rollup.Rollup(spark, str(tmp_path / "roll"))
    schema = "doc_id long, version string, op string, source string, lang string, n_tokens long, batch string"
    commit = lambda n, rows: r.commit(n, spark.createDataFrame([(*x, "clash") for x in rows], schema))
    assert r.totals().count() == 0
    first = [(1, "v1", "insert", "a", "en", 10), (2, "v1", "insert", "a", None, 5), (1, "v2", "insert", "a", "en", 7), (1, "v1", "insert", "a", "en", 10), (None, "v1", "insert", "a", "en", 9), (3, "v1", "revise", "a", "en", 4)]
    assert commit(1, first)
    assert not commit(1, first)
    assert commit(2, [(1, "v1", "revise", None, None, 12), (2, "v1", "delete", None, None, None), (2, "v1", "revise", None, None, 8)])
    assert commit(3, [(2, "v1", "delete", None, None, None), (1, "v2", "insert", "b", "de", 1)])
    got = {tuple(x) for x in r.totals().select("source", "lang", "version", "n_docs", "n_tokens").collect()}
    assert got == {("a", "en", "v1", 1, 12), ("b", "de", "v2", 1, 1)}
    assert {(x["doc_id"], x["version"], x["n_tokens"]) for x in r.ledger().collect()} == {(1, "v1", 12), (1, "v2", 1)}


def test_rollup_refuses_batches_out_of_order_and_compacts(spark, tmp_path):
    r = token_rollup.Rollup(spark, str(tmp_path / "roll"), compact_after=2)
    commit = lambda n, rows: r.commit(n, spark.createDataFrame(rows, "doc_id long, version string, op string, source string, lang string, n_tokens long"))
    assert commit(5, [(1, "v", "insert", "a", "en", 10)])
    with pytest.raises(ValueError):
        commit(3, [(1, "v", "insert", "a", "en", 7)])
    counts = {1: 10}
    for n in range(6, 13):
        rows = [(1, "v", "revise", None, None, n)] if n % 3 else [(1, "v", "delete", None, None, None)]
        rows.append((n, "v", "insert", "a", "en", n))
        assert commit(n, rows)
        counts = {k: v for k, v in (counts | {n: n}).items() if k != 1 or n % 3} | ({1: n} if n % 3 and 1 in counts else {})
    assert {(x["doc_id"], x["n_tokens"]) for x in r.ledger().collect()} == set(counts.items())
    assert [tuple(x)[3:] for x in r.totals().collect()] == [(len(counts), sum(counts.values()))]
    assert len(r._parts()) <= 4 and r._complete("state")
    assert len(r._parts("sums", "changes")) <= 4 and r._complete("sums")


@have_data
@pytest.mark.skipif(not os.path.exists(token_rollup.VOCABULARY), reason="no vocabulary")
def test_token_query_against_plain_counts(spark):
    import re

    import tiktoken

    coder = tiktoken.Encoding("t", pat_str=token_rollup.PATTERN, mergeable_ranks=token_rollup.load_ranks(), special_tokens={})
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    first = {}
    for d in docs:
        if d["text"] is not None:
            first[d["text"]] = min(d["doc_id"], first.get(d["text"], d["doc_id"]))
    want = defaultdict(lambda: [0, 0])
    for d in docs:
        t = d["text"]
        if t is None or first[t] == d["doc_id"]:
            flat = None if t is None else re.sub(r"[\x20\x09-\x0D]{2,}", " ", t)
            for version, n in (("words", len(words(t))), ("byte_bpe_50k", 0 if t is None else len(coder.encode_ordinary(flat)))):
                want[d["source"], d["lang"], version][0] += 1
                want[d["source"], d["lang"], version][1] += n
    got = {tuple(r[:3]): list(r[3:]) for r in token_rollup.op8_token_counts(spark, DATA).select("source", "lang", "version", "n_docs", "n_tokens").collect()}
    assert got == dict(want)


def test_token_query_of_awkward_rows(spark, docs, tmp_path):
    docs.drop("id", "th").write.parquet(str(tmp_path / "a/documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "b/documents.parquet"))
    assert token_rollup.op8_token_counts(spark, str(tmp_path / "b")).count() == 0
    live = docs.where("doc_id is not null").agg(F.count_distinct("doc_id")).first()[0]
    out = token_rollup.op8_token_counts(spark, str(tmp_path / "a")).groupBy("version").agg(F.sum("n_docs").alias("n")).collect()
    assert len(out) == 2 and all(0 < r["n"] <= live for r in out)


def test_rollup_takes_up_a_broken_batch(spark, tmp_path):
    r = token_rollup.Rollup(spark, str(tmp_path / "roll"))
    events = spark.createDataFrame([(1, "v", "insert", "a", "en", 3)], "doc_id long, version string, op string, source string, lang string, n_tokens long")
    spark.createDataFrame([("x", "y", "v", 9, 99, 1)], token_rollup.CHANGES).write.parquet(str(tmp_path / "roll/changes/1"))
    assert r.totals().count() == 0
    assert r.commit(1, events)
    assert [tuple(x)[3:] for x in r.totals().collect()] == [(1, 3)]


@pytest.mark.skipif(not os.path.exists(token_rollup.VOCABULARY), reason="no vocabulary")
def test_token_counts(spark, docs):
    import tiktoken

    coder = tiktoken.Encoding("t", pat_str=token_rollup.PATTERN, mergeable_ranks=token_rollup.load_ranks(), special_tokens={})
    got = token_rollup.count_tokens(docs.select("id", "text", F.upper("text").alias("up")), text_cols=["text", "up"]).collect()
    texts = {r["id"]: r["text"] for r in docs.select("id", "text").collect()}
    for r in got:
        t = texts[r["id"]]
        assert (r["n_text"], r["n_up"]) == ((None, None) if t is None else (len(coder.encode_ordinary(t)), len(coder.encode_ordinary(t.upper()))))


@have_data
def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = langid.op2_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_language_of_awkward_rows(spark, docs, rows):
    model = langid.ByteCNN(["en", "xx"])
    out = langid.identify(docs, model, keep=["id", "text", "score", "text_"], rename={"score": "p"}).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r["p"] <= 1 and r["score"] == 0.5 and r["text_"] == "clash"
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    untrained = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, untrained).collect()} == {"und"}


@have_data
def test_toxicity_of_held_out_texts(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    out = toxicity.op3_toxicity(spark, DATA).join(labels, "doc_id").where("held_out")
    r = out.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("hit"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("false")).first()
    assert r["hit"] > 0.7 and r["false"] < 0.05


def test_toxicity_of_awkward_rows(spark, docs, rows):
    labels = spark.createDataFrame([(100 + i, i % 2, "x") for i in range(40)] + [(None, 1, "x"), (101, None, "x")], "doc_id long, toxic int, id string")
    model = toxicity.train(docs, labels)
    out = toxicity.tag(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    empty = toxicity.train(docs.limit(0), labels.limit(0))
    assert {round(r["score"], 6) for r in toxicity.tag(docs, empty).collect()} == {round(1 / (1 + 99), 6)}


def test_marginals_against_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    score, trans, begins = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 4, 5])
    p, pairs = toxicity.marginals(score, begins, trans)
    want, total = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(begins, [*begins[1:], 9], strict=True):
        weights = {}
        for y in itertools.product((0, 1), repeat=b - a):
            weights[y] = math.exp(sum(score[a + i] * s for i, s in enumerate(y)) + sum(trans[s, t] for s, t in zip(y, y[1:], strict=False)))
        z = sum(weights.values())
        for y, w in weights.items():
            want[a:b] += np.array(y) * w / z
            for s, t in zip(y, y[1:], strict=False):
                total[s, t] += w / z
    assert np.allclose(p, want) and np.allclose(pairs, total)
