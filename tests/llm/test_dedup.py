"""Near-duplicates, substring and suffix dedup, components: against brute force on awkward rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from scorewright.llm import debruijn, minhash, rolling, suffix_dedup, windows
from scorewright.llm import components as comp
from scorewright.llm.common import Store
from tests.llm.cases import LOWER, SCHEMA, components, corpus, words


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(300, i) for i in range(301, 400)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in comp.components(df, Store(spark, "t")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert got == components({x for e in real for x in e}, real)
    assert comp.components(df.limit(0), Store(spark, "t")).count() == 0


def test_near_duplicates(docs, rows):
    sets = []
    for r in rows:
        w = words(r[1] and r[1].translate(LOWER))
        sets.append((r[0], frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()))
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if None not in (a, b) and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    label = components({d for d, _ in sets if d is not None}, links)
    want = Counter((d, len(s), label.get(d) if d is not None and s else d, d is None or (label[d] if s else d) == d) for d, s in sets)
    got = minhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    # rows of one id are one node
    assert Counter(map(tuple, got.collect())) == want


def test_an_id_with_two_texts_ties_them(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(20, a), (24, a), (24, b), (30, b), (31, "alone")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert got == Counter([(20, 20, True), (24, 20, False), (24, 20, False), (30, 20, False), (31, 31, True)])


def test_pairs_just_above_the_threshold_are_found(spark):
    """Pairs at a similarity of 0.80 to 0.82, none alike with another: recall counted."""
    out, want = [], 0
    for i in range(300):
        shared = [f"p{i}w{k}" for k in range(83 + i % 4)]
        one, two = shared + [f"q{i}x{k}" for k in range(10)], shared + [f"r{i}y{k}" for k in range(10)]
        x, y = ({tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in (one, two))
        want += 100 * len(x & y) >= 80 * len(x | y)
        out += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
    got = minhash.near_duplicates(spark.createDataFrame(out, "doc_id long, text string")).where("not kept").count()
    assert want > 100 and got == want


def test_near_duplicates_in_large_buckets(spark):
    """Hundreds of near copies of one text, some too far from any other: no link lost, none invented."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    out = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        out.append((i, " ".join(w)))
    sets = [frozenset(tuple(t.split()[k : k + 4]) for k in range(117)) for _, t in out]
    links = [(i, j) for i in range(300) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = components(range(300), links)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    assert got == want


def removed(sequences, length):
    """Which symbols a window of `length` covers that starts twice or more."""
    seen = Counter(tuple(s[i : i + length]) for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if seen[tuple(s[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


@pytest.mark.parametrize("length", [35])
def test_substring_dedup(docs, rows, length):
    texts = [words(r[1]) for r in rows]
    want = Counter()
    for r, w, gone in zip(rows, texts, removed(texts, length), strict=True):
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want[(r[0], len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())] += 1
    got = debruijn.substring_dedup(docs, length=length)
    assert Counter(map(tuple, got.collect())) == want


def test_substring_dedup_keeps_columns_and_text(docs, rows):
    got = debruijn.substring_dedup(docs, keep_text=True, keep=["id", "lang", "rest"]).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    for r in rows:
        o = by[r[5]]
        assert o["lang"] == r[2] and (o["n_removed"] > 0 or o["kept_text"] == r[1])


def test_a_row_repeated_whole_is_a_copy(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(900))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text[:300]), (None, "x" * 500)], "doc_id long, text string")
    got = sorted(tuple(r)[:4] for r in suffix_dedup.suffix_dedup(docs.where("doc_id is not null")).collect())
    assert got == [(1, 900, 900, 1), (1, 900, 900, 1), (2, 300, 0, 0)]
    assert [tuple(r)[:4] for r in suffix_dedup.suffix_dedup(docs.where("doc_id is null")).collect()] == [(None, 500, 500, 1)]


@pytest.mark.parametrize("length", [400, 60])
def test_suffix_dedup(docs, rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, t, gone in zip(rows, texts, removed(texts, length), strict=True):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want[(r[0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    got = suffix_dedup.suffix_dedup(docs, length=length, batches=3)
    assert Counter(map(tuple, got.collect())) == want


def test_shared_passages_of_over_50_words_count_by_their_bytes(spark):
    """Each passage stands in two texts that are otherwise unlike: those of 400 bytes and more go from both, shorter ones stay."""
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows, want = [], {}
    for i, n in enumerate((323, 398, 399, 400, 401, 575)):
        size, over = divmod(n - 50, 51)
        passage = " ".join(letters(size + (w < over)) for w in range(51))
        assert len(passage) == n and len(passage.split()) == 51
        # other bytes on either side of the passage, so that no match goes beyond it
        for k, (a, z) in enumerate(("13", "24")):
            before, after = " ".join(letters(6) for _ in range(40)) + a, z + " ".join(letters(6) for _ in range(30))
            kept = before + after if n >= 400 else before + passage + after
            rows.append((2 * i + k, before + passage + after))
            want[2 * i + k] = (n if n >= 400 else 0, int(n >= 400), hashlib.sha256(kept.encode()).hexdigest())
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()} == want


@pytest.mark.parametrize("small", [False, True])
def test_suffix_levels_are_in_order_and_scans_find_all(docs, spark, small, monkeypatch):
    """Levels grow geometrically, hold every sampled suffix in the order of its bytes, and every lead that recurs in any batch is found."""
    if small:
        monkeypatch.setattr(suffix_dedup, "BLOCK", 16)
        monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 4000)
    keyed = windows.keyed(docs, "doc_id", "text")
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0]
    store = Store(spark, "levels")
    index = suffix_dedup.SuffixIndex(store, 60, size)
    sizes = []
    for b in range(5):
        index.add(keyed.where(F.pmod("th", F.lit(5)) == b))
        sizes.append([n for n, _ in index.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]
    every = windows.super_rows(keyed, "bytes", 60, 15, lead=True).collect()
    place = lambda r: (r["id"], r["th"], r["first"])
    keys = []
    for _, level in index.levels:
        blocks = level.select("top", "least", "n", "keys", "id", "th", "first").orderBy("top", "least").collect()
        assert not small or (len(blocks) > 20 and len({r["top"] for r in blocks}) > 5)
        own = [bytes(r["keys"])[i * 23 : i * 23 + 23] for r in blocks for i in range(r["n"])]
        assert own == sorted(own)
        keys += [(k[:15], *p) for k, p in zip(own, [p for r in blocks for p in zip(r["id"], r["th"], r["first"], strict=True)], strict=True)]
    assert Counter(keys) == Counter((bytes(r["lead"]), *place(r)) for r in every)
    often = Counter(bytes(r["lead"]) for r in every)
    found = {place(r) for r in index.candidates().collect()}
    assert {place(r) for r in every if often[bytes(r["lead"])] > 1} <= found
    assert small or len(found) < len(every)


def test_copies_in_a_later_batch_are_dealt_to_several_ranges(spark, monkeypatch):
    """Each lead of a text with many copies would fill eight ranges; the copies lie in one batch, which is not the first."""
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 13_000)
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    often = spark.createDataFrame([(text(1000),) for _ in range(16)], "text string").where(F.pmod(F.xxhash64("text"), F.lit(4)) == 2).first()["text"]
    rows = [(i, text(1000)) for i in range(300)] + [(1000 + i, often) for i in range(1500)] + [(3000, text(30_000)), (3001, None), (3002, "")]
    loads, built = [], suffix_dedup.SuffixIndex._built

    def watched(index, raw):
        array = built(index, raw)
        loads.append([r["n"] for r in array.groupBy("top").agg(F.sum("n").alias("n")).collect()])
        return array

    monkeypatch.setattr(suffix_dedup.SuffixIndex, "_built", watched)
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length=60)
    gone = {r["doc_id"]: r["n_removed"] for r in got.collect()}
    size = len(often.encode())
    assert {d: n for d, n in gone.items() if n} == {1000 + i: size for i in range(1500)} and len(gone) == len(rows)
    assert len(loads) == 4 and sum(loads[2]) > 1500 * 25 and max(loads[2]) < 1000


def test_merging_runs_and_their_common_prefixes():
    rng = random.Random(9)
    word = lambda: bytes(rng.choice((0, 1, 255)) for _ in range(12))
    a, b = (sorted(word() for _ in range(n)) for n in (300, 170))
    run = lambda x, side: suffix_dedup.Run(np.array(x, "S12"), {"side": np.full(len(x), side)})
    both = suffix_dedup.Run.merged(run(a, 0), run(b, 1))
    assert [k.ljust(12, b"\0") for k in both.keys.tolist()] == sorted(a + b) and both.columns["side"].sum() == len(b)
    plain = lambda x, y: next((i for i in range(4) if x[i] != y[i]), 4)
    order = sorted(a + b)
    assert suffix_dedup.common_prefixes(both.leads(4)).tolist() == [plain(x, y) for x, y in zip(order, order[1:], strict=False)]


def test_nothing_is_removed_without_the_index(docs, monkeypatch):
    assert suffix_dedup.suffix_dedup(docs, length=60).agg(F.sum("n_removed")).first()[0] > 0
    monkeypatch.setattr(suffix_dedup.SuffixIndex, "candidates", lambda self: self.marked[0].where("1 = 0"))
    assert suffix_dedup.suffix_dedup(docs, length=60).agg(F.sum("n_removed")).first()[0] == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(none).count() == 0
    assert debruijn.substring_dedup(none).count() == 0
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_sliding_minimum():
    x = np.random.default_rng(0).integers(0, 50, 97).astype(np.uint64)
    for width in (1, 2, 13, 97):
        assert rolling.sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]
    assert len(rolling.sliding_min(x, 98)) == 0


def test_words_of_chunks():
    texts = ["ab  cd\n", None, "", "ef", "g\x0bh é"]
    got = []
    for chunk in rolling.chunks(pa.array(texts, pa.string()), most=4):
        w = rolling.Words(chunk)
        for i in range(chunk.hi - chunk.lo):
            got.append([bytes(chunk.data[a:b]).decode() for a, b in zip(w.start[w.offsets[i] : w.offsets[i + 1]], w.end[w.offsets[i] : w.offsets[i + 1]], strict=True)])
    assert got == [words(t) for t in texts]
    whole = next(rolling.chunks(pa.array(["ab", "ab"], pa.string())))
    assert len(set(rolling.Words(whole).hash.tolist())) == 1


def test_spans_are_read_again_in_their_source(spark):
    """Two documents are told to hold a path that a third holds in part, and one whose words differ where hashes would say they do not."""
    first, second, odd = ([f"{c}{i}" for i in range(40)] for c in "abx")
    texts = [first + second, ["pre"] + first + second, first + odd]
    docs = spark.createDataFrame([(i, i, " ".join(t)) for i, t in enumerate(texts)], "id long, th long, text string")
    # windows of 40 words: one edge of 41 windows in two halves, placed in all three documents
    placed = [(i, i, at + off, at + off + 19 + at // 20, edge) for i, off in ((0, 0), (1, 1), (2, 0)) for at, edge in ((0, 11), (20, 22))]
    spans = debruijn.path_spans(spark.createDataFrame(placed, "id long, th long, first int, last int, edge long"), spark.createDataFrame([(11, 7, 0), (22, 7, 20)], "edge long, path long, shift long"))
    assert spans.where("whole").count() == 3 and spans.select("key").distinct().count() == 1
    got = {tuple(r) for r in debruijn.settled(spans, docs, Store(spark, "source"), 40).collect()}
    covered = {(i, w) for i, _, a, b in got for w in range(a, b + 1)}
    assert covered == {(0, w) for w in range(41)} | {(1, w) for w in range(1, 42)}


def test_no_span_without_the_graph(docs, monkeypatch):
    """Spans are those of paths: with no path there is none."""
    assert debruijn.substring_dedup(docs).where("n_removed > 0").count() > 0
    monkeypatch.setattr(debruijn, "compacted", lambda edges, store: edges.selectExpr("edge", "edge as path", "0L as shift").limit(0))
    assert debruijn.substring_dedup(docs).where("n_removed > 0").count() == 0
