"""Ranked lexical search by sort-based accumulation of integer impacts.

Documents are read once for the terms that items hold. In a second pass each task
concatenates (item, document, impact) entries of its documents, orders them by radix
passes over packed keys, adds runs of equal keys up and keeps the best of each item
in a heap. The tasks' survivors are dealt out by ranges of item and document, so that
no item gathers in one place, and chosen from again.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from scorewright.llm import rolling as R
from scorewright.llm.common import Store, arrow_batches, documents

TOP = 20
#: Distinct (item, term) pairs that are searched for together; more take another pass over the documents.
BLOCK_PAIRS = 1 << 20
#: (item, document, impact) entries that a task orders together.
ENTRIES = 1 << 20
_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of terms: digits, letters, and all of characters beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Vocabulary:
    """Terms of a block of items: sorted hashes, byte lengths, and the items of each term with how often they hold it."""

    hashes: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Vocabulary:
        """From (item_id, term, times)."""
        ids = sorted({r[0] for r in rows})
        place = {i: p for p, i in enumerate(ids)}
        terms = sorted({r[1] for r in rows})
        raw = [t.encode() for t in terms]
        w = R.Words(next(R.chunks(pa.array(raw, pa.binary()), 1 << 62)), letters=LETTERS)
        order = np.argsort(w.hash)
        rank = {t: int(p) for t, p in zip(terms, np.argsort(order), strict=True)}
        entries = sorted((rank[t], place[i], n) for i, t, n in rows)
        term, item, times = (np.array(x, np.int64) for x in zip(*entries, strict=True))
        return cls(w.hash[order], (w.end - w.start)[order], np.searchsorted(term, np.arange(len(terms) + 1)), item, times, np.array(ids, np.int64))

    def found(self, words: R.Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and which terms those are."""
        at = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
        same = (self.hashes[at] == words.hash) & (self.sizes[at] == words.end - words.start)
        return np.flatnonzero(same), at[same]


def _slices(chunk: R.Chunk) -> Iterator[R.Chunk]:
    """A text larger than a chunk in parts, cut where no term runs on; other chunks as they are."""
    data = chunk.data
    if chunk.hi - chunk.lo > 1 or len(data) <= 2 * R.CHUNK_BYTES:
        yield chunk
        return
    at = 0
    while at < len(data):
        stop = min(len(data), at + R.CHUNK_BYTES)
        while stop < len(data):
            gaps = np.flatnonzero(~LETTERS[data[stop : stop + R.CHUNK_BYTES]])
            stop = stop + int(gaps[0]) if len(gaps) else min(len(data), stop + R.CHUNK_BYTES)
            if len(gaps):
                break
        yield R.Chunk(chunk.lo, chunk.hi, data[at:stop], np.array([0, stop - at], np.int64))
        at = stop


def matched(texts: pa.Array, v: Vocabulary) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, terms of each text with repeats, and of its matches: row, term, occurrences) for stretches of a batch."""
    for chunk in R.chunks(texts):
        rows = chunk.hi - chunk.lo
        length, keys, counts = np.zeros(rows, np.int64), [], []
        for part in _slices(chunk):
            w = R.Words(part, lower=True, letters=LETTERS)
            length += np.diff(w.offsets)
            where, term = v.found(w)
            row = np.repeat(np.arange(rows), np.diff(w.offsets))[where]
            k, n = np.unique(row * len(v.hashes) + term, return_counts=True)
            keys.append(k)
            counts.append(n)
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)
        yield chunk.lo, length, k // len(v.hashes), k % len(v.hashes), n


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """Order of keys of so many bits: stable radix passes over 16 of them at a time."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        digit = (keys[order] >> shift & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
    return order


def accumulated(item: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, score) of entries added up by (item, doc), in that order."""
    low = max(1, (docs - 1).bit_length())
    keys = item << low | doc
    order = radix_order(keys, low + int(item.max()).bit_length() if len(item) else 1)
    keys, impact = keys[order], impact[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[starts] >> low, keys[starts] & (1 << low) - 1, np.add.reduceat(impact, starts) if len(starts) else impact


class Best:
    """The `most` best (score, document) of each item, in heaps; of equal scores the lesser document."""

    def __init__(self, items: int, most: int):
        self.most, self.heaps, self.bar = most, [[] for _ in range(items)], np.zeros(items, np.int64)

    def take(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        good = np.flatnonzero((score > 0) & (score >= self.bar[item]))
        for i, d, s in zip(item[good].tolist(), doc[good].tolist(), score[good].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.most:
                heapq.heappush(heap, (s, -d))
            elif (s, -d) > heap[0]:
                heapq.heapreplace(heap, (s, -d))
            if len(heap) == self.most:
                self.bar[i] = heap[0][0]

    def rows(self, ids: np.ndarray) -> pa.RecordBatch:
        found = [(int(ids[i]), -d, s) for i, heap in enumerate(self.heaps) for s, d in heap]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in found], pa.int64()) for j in range(3)], names=["item_id", "doc_id", "score"])


def ranked(docs: DataFrame, items: DataFrame, *, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """The `top` highest-scoring documents of each item: item_col, rank (from 1), id_col, score (above 0).

    Terms are maximal runs of digits, letters and characters beyond ASCII in the whole
    text, A-Z lower-cased. With N documents that hold a term, L terms in all, n of one
    document, df documents with the term and tf occurrences, a term weighs
    floor(1000 ln((2N + 2) / (2 df + 1))), and a document scores the sum of weight *
    (10**9 tf div (1000 tf + 12 m)) over the item's terms, m = 75 + (25 n N div L).
    Equal scores go by ascending id, rows of one id are documents of their own. Rows
    with a null id count in N, L and df but are not returned; null and empty texts hold
    nothing. Rows of one item id with different texts make one item with the terms of
    all; repeated rows count once, null item ids not at all. An item without a term
    that a document holds, or an empty table, gives no rows. Other columns are not read.

    Terms are told by 64-bit hashes and lengths. Items are searched for in blocks of
    about `block_pairs` distinct (item, term) pairs, which bounds what is broadcast
    by that or one item's own terms; every further block is another pass over the documents.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    store = Store(spark, "ranked")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    terms = F.regexp_extract_all(F.translate(F.coalesce(item_text_col, F.lit("")), _UPPER, _LOWER), F.lit(_TERM), F.lit(0))
    wanted = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col)).distinct().select("item", F.explode(terms).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))
    wanted = store.keep(wanted, "wanted")
    blocks = max(1, math.ceil(2 * wanted.count() / block_pairs))
    found = [_block(docs, wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), top, store) for b in range(blocks)]
    schema = f"{item_col} long, rank int, {id_col} long, score long"
    found = [f for f in found if f is not None]
    if not found:
        return spark.createDataFrame([], schema)
    best = found[0]
    for f in found[1:]:
        best = best.unionByName(f)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of each item among a partition's rows; as many items are open as it has."""
        seen: dict[int, list] = {}
        for batch in batches:
            for i, d, s in zip(*(batch[c].to_pylist() for c in ("item_id", "doc_id", "score")), strict=True):
                heap = seen.setdefault(i, [])
                if len(heap) < top:
                    heapq.heappush(heap, (s, -d))
                elif (s, -d) > heap[0]:
                    heapq.heapreplace(heap, (s, -d))
        rows = [(i, -d, s) for i, heap in seen.items() for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["item_id", "doc_id", "score"])

    # ranges of item and document first: an item with very many survivors is in several tasks
    thinned = store.keep(best.repartitionByRange("item_id", "doc_id").mapInArrow(chosen, best.schema), "thinned")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    last = thinned.repartitionByRange("item_id").withColumn("rank", place).where(F.col("rank") <= top)
    return last.select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score")


def _block(docs: DataFrame, wanted: DataFrame, top: int, store: Store) -> DataFrame | None:
    """Each task's best documents of a block of items, written to the shared folder; None if there are none."""
    rows = wanted.collect()
    if not rows:
        return None
    v = Vocabulary.of(rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with matches: its length, terms and occurrences; and last the task's own counts."""
        texts = total = 0
        held = np.zeros(len(v.hashes), np.int64)
        for batch in batches:
            for lo, length, row, term, n in matched(batch["text"], v):
                texts, total = texts + int((length > 0).sum()), total + int(length.sum())
                held += np.bincount(term, minlength=len(held))
                ids = batch["id"].slice(lo, len(length))
                some = np.unique(row)
                cut = np.concatenate((np.searchsorted(row, some), [len(row)])).astype(np.int32)
                lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(kind))) for x, kind in ((term, np.int32), (n, np.int64))]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(length[some]), *lists, pa.array(np.zeros(len(some), bool))], names=["id", "n", "terms", "times", "counts"])
        k = np.flatnonzero(held)
        lists = [pa.array([x], pa.list_(kind)) for x, kind in ((k.astype(np.int32), pa.int32()), (held[k], pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array([texts]), pa.array([total]), *lists, pa.array([True])], names=["id", "n", "terms", "times", "counts"])

    seen = store.keep(docs.mapInArrow(scan, "id long, n long, terms array<int>, times array<long>, counts boolean"), "matched")
    told = seen.where("counts")
    texts, total = told.agg(F.coalesce(F.sum("id"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        return None
    df = np.zeros(len(v.hashes), np.int64)
    # one row for each term of the block
    for r in told.select(F.explode(F.arrays_zip("terms", "times")).alias("t")).groupBy("t.terms").agg(F.sum("t.times").alias("n")).collect():
        df[r["terms"]] = r["n"]
    weight = np.array([math.floor(1000 * math.log((2 * texts + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    several = np.diff(v.starts)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(v.ids), top)
        for batch in batches:
            ids, n, lists = batch["id"].to_numpy(), batch["n"].to_numpy(), batch["terms"]
            term, tf = lists.flatten().to_numpy().astype(np.int64), batch["times"].flatten().to_numpy()
            doc = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            m = 75 + 25 * n * texts // total
            impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
            upto = np.cumsum(several[term])
            for lo, hi in _stretches(doc, upto):
                t, d = term[lo:hi], doc[lo:hi]
                each = several[t]
                at = np.repeat(v.starts[t] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
                item, place, gain = accumulated(v.items[at], np.repeat(d - d[0], each), np.repeat(impact[lo:hi], each) * v.times[at], int(d[-1] - d[0]) + 1)
                best.take(item, ids[place + d[0]], gain)
        yield best.rows(v.ids)

    return store.keep(seen.where("not counts and id is not null").mapInArrow(score, "item_id long, doc_id long, score long"), "best")


def _stretches(doc: np.ndarray, upto: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of a batch's matches of about ENTRIES entries, whole documents each."""
    begins = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    lo, done = 0, 0
    while lo < len(doc):
        hi = int(np.searchsorted(upto, done + ENTRIES, side="right"))
        k = int(np.searchsorted(begins, hi, side="right")) - 1
        hi = len(doc) if hi >= len(doc) else int(begins[k]) if begins[k] > lo else int(begins[k + 1]) if k + 1 < len(begins) else len(doc)
        yield lo, hi
        lo, done = hi, int(upto[hi - 1])


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
