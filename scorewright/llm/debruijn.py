"""Repeated word spans from a compacted De Bruijn graph.

Windows of `length` words are edges between their first and last `length - 1` words.
Edges that repeat are found as runs which share a minimizer (windows.py), so an edge
here is a run of one or more windows. Where a node has one edge in and one out, the
two are one path; pointer doubling joins paths to their first edge, in rounds that
are as many as the logarithm of the longest path. Runs of a document that follow one
another on a path are one span of it. A span is verified against its source: the words
at its coordinates are read again, and another span of the same stretch of the path
must have the same words (by their 128-bit BLAKE2 digest). Where a document holds a
stretch of a path that no other holds from end to end, its edges are verified singly.
Only verified spans count, so no result rests on the 64-bit hashes that found it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import rolling as R
from scorewright.llm import windows as W
from scorewright.llm.common import Store, arrow_batches, documents

LENGTH = 35
GRAM = 14


def edges_of(classes: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Edges of the representatives: whole runs of classes that repeat (`whole`), and single windows of runs that differ.

    Columns: id, th, at, size, key, fp, n, whole, tail, tip (hashes of the node the edge leaves and enters).
    """
    wanted = classes.where("n > 1 or kinds > 1").groupBy("id", "th").agg(F.collect_list(F.struct("first", "last", "fp", "sx", "n", "kinds")).alias("runs")).withColumnsRenamed({"id": "id_", "th": "th_"})
    told = docs.join(wanted, docs["id"].eqNullSafe(wanted["id_"]) & (docs["th"] == wanted["th_"])).select("id", "th", "text", "runs")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in R.chunks(batch["text"]):
                sym = W.Symbols(chunk, "words")
                poly = R.Poly(sym.hash)
                own = batch["runs"].slice(chunk.lo, chunk.hi - chunk.lo)
                flat = own.flatten()
                doc = np.repeat(np.arange(chunk.hi - chunk.lo), own.value_lengths().to_numpy())
                first, last, fp, sx, n, kinds = (flat.field(c).to_numpy() for c in ("first", "last", "fp", "sx", "n", "kinds"))
                # windows of runs that have differing ones beside them, then whole runs
                split = np.flatnonzero(kinds > 1)
                size = last[split] - first[split] + 1
                which = np.repeat(split, size)
                at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + first[which]
                place = sym.offsets[doc[which]] + at
                key = R.signed(R.mix(poly.of(place, place + length) ^ fp.view(np.uint64)[which]))
                runs = np.flatnonzero(n > 1)
                which, at = np.concatenate((which, runs)), np.concatenate((at, first[runs])).astype(np.int32)
                key = np.concatenate((key, sx[runs]))
                whole = np.arange(len(which)) >= len(which) - len(runs)
                size = np.where(whole, last[which] - first[which] + 1, 1).astype(np.int32)
                start = sym.offsets[doc[which]] + at
                tail, tip = poly.of(start, start + length - 1), poly.of(start + size, start + size + length - 1)
                row = pa.array(doc[which] + chunk.lo)
                yield pa.RecordBatch.from_arrays([batch["id"].take(row), batch["th"].take(row), *(pa.array(x) for x in (at, size, key, fp[which], n[which], whole, R.signed(tail), R.signed(tip)))], names=["id", "th", "at", "size", "key", "fp", "n", "whole", "tail", "tip"])

    return told.mapInArrow(task, "id long, th long, at int, size int, key long, fp long, n long, whole boolean, tail long, tip long")


def compacted(edges: DataFrame, store: Store) -> DataFrame:
    """Path of each edge (edge, tail, tip, size): rows (edge, path, shift), `shift` windows after the path's first.

    A node with one edge in and one out joins its edges. Edges on a circle of such
    nodes have no first one and stay paths of their own.
    """
    out = edges.groupBy("tail").agg(F.count("*").alias("c"), F.max("edge").alias("later")).where("c = 1")
    into = edges.groupBy("tip").agg(F.count("*").alias("c"), F.max(F.struct("edge", "size")).alias("e")).where("c = 1")
    joints = out.join(into, out["tail"] == into["tip"]).select("later", F.col("e.edge").alias("earlier"), F.col("e.size").alias("step")).where("later <> earlier")
    state = edges.join(joints, edges["edge"] == joints["later"], "left").select("edge", F.coalesce("earlier", "edge").alias("path"), F.coalesce("step", F.lit(0)).cast("long").alias("shift"), F.col("earlier").isNotNull().alias("open"))
    state, left = store.keep(state, "paths"), -1
    while True:
        now = state.where("open").count()
        if now == 0 or now == left:
            break
        left = now
        # every edge's ancestor is looked up; several edges never have one ancestor, so no key is frequent
        up = state.select(F.col("edge").alias("anc"), F.col("path").alias("path2"), F.col("shift").alias("shift2"), F.col("open").alias("open2"))
        stepped = state.where("open").join(up, F.col("path") == F.col("anc")).select("edge", F.col("path2").alias("path"), (F.col("shift") + F.col("shift2")).alias("shift"), F.col("open2").alias("open"))
        after = store.keep(stepped.unionByName(state.where("not open")), "paths")
        store.drop(state)
        state = after
    return state.select("edge", F.when(F.col("open"), F.col("edge")).otherwise(F.col("path")).alias("path"), F.when(F.col("open"), 0).otherwise(F.col("shift")).alias("shift"))


def verified(units: DataFrame, docs: DataFrame, store: Store, length: int) -> tuple[DataFrame, DataFrame]:
    """Units (id, th, first, last, key) whose source words another unit of their key has too, and the rest.

    A row that stands several times counts as often.
    """
    lists = units.distinct().groupBy("id", "th").agg(F.collect_list(F.struct("first", "last", "key")).alias("runs"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, row, digest = batch["runs"], [], []
            for i, text in enumerate(batch["text"].cast(pa.large_binary())):
                words = text.as_py().split()
                own = runs[i].values
                for first, last in zip(own.field("first").to_pylist(), own.field("last").to_pylist(), strict=True):
                    row.append(i)
                    digest.append(hashlib.blake2b(b" ".join(words[first : last + length]), digest_size=16).digest())
            flat, at = runs.flatten(), pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["id"].take(at), batch["th"].take(at), *(flat.field(c) for c in ("first", "last", "key")), pa.array(digest, pa.binary())], names=["id", "th", "first", "last", "key", "digest"])

    read = store.keep(W.with_lists(docs, lists).mapInArrow(task, "id long, th long, first int, last int, key long, digest binary"), "digests")
    equal = W.alike(store.keep(read.groupBy("key", "digest").agg(F.count("*").alias("c")).where("c > 1").select("key", "digest"), "equal"))
    return read.join(equal, ["key", "digest"], "left_semi").drop("digest"), read.join(equal, ["key", "digest"], "left_anti").drop("digest")


def path_spans(placed: DataFrame, paths: DataFrame) -> DataFrame:
    """Occurrences of paths: id, th, path, first, last, key (of the stretch of the path), whole (without a gap), pieces.

    `placed` has the edges of documents (id, th, first, last, edge). Edges of one document
    that lie on one path at the same distance from its start make one occurrence.
    """
    line = (F.col("first") - F.col("shift")).alias("line")
    spans = placed.join(paths, "edge").groupBy("id", "th", "path", line).agg(F.min("first").alias("a"), F.max("last").alias("b"), F.sum(F.col("last") - F.col("first") + 1).alias("n"), F.collect_set(F.struct("first", "last", F.col("edge").alias("key"))).alias("pieces"))
    key = F.xxhash64("path", F.col("a") - F.col("line"), F.col("b") - F.col("line")).alias("key")
    return spans.select("id", "th", "path", F.col("a").alias("first"), F.col("b").alias("last"), key, (F.col("n") == F.col("b") - F.col("a") + 1).alias("whole"), "pieces")


def settled(spans: DataFrame, docs: DataFrame, store: Store, length: int) -> DataFrame:
    """Windows (id, th, first, last) of the occurrences that the source words bear out.

    A path all of whose occurrences share their stretch with another is verified by
    occurrence, any other path by edge, as two occurrences may share only a part. So are
    the paths of occurrences that fail, that is, of edges told equal by their hashes alone.
    """
    stretches = spans.groupBy("path", "key").agg(F.count("*").alias("c"), F.min("whole").alias("whole"))
    parted = store.keep(stretches.where("c = 1 or not whole").select("path").distinct(), "parted")
    by_span = store.keep(spans.join(W.alike(parted), "path", "left_anti").select("id", "th", "first", "last", "key", "path"), "whole")
    whole, failed = verified(by_span.drop("path"), docs, store, length)

    def edges_on(some: DataFrame) -> DataFrame:
        own = spans.join(W.alike(some), "path", "left_semi").select("id", "th", F.explode("pieces").alias("r"))
        return verified(own.select("id", "th", "r.first", "r.last", "r.key"), docs, store, length)[0]

    found = whole.unionByName(edges_on(parted))
    if not failed.isEmpty():
        again = by_span.join(failed.select("key").distinct(), "key", "left_semi").select("path").distinct()
        found = found.unionByName(edges_on(store.keep(again, "failed")))
    return found.select("id", "th", "first", "last")


def repeated_spans(docs: DataFrame, store: Store, length: int = LENGTH, k: int = GRAM) -> DataFrame:
    """Window starts that repeat, as verified spans of the compacted paths: id, th, first, last."""
    rows = store.keep(W.super_rows(docs, "words", length, k), "rows")
    again = store.keep(W.repeated_rows(rows, store), "candidates")
    store.drop(rows)
    classes = store.keep(W.classes_of(again, store), "classes")
    found = store.keep(edges_of(classes, docs, length), "edges")
    windows = found.where("not whole")
    single = store.keep(W.shared_windows(windows, store), "single")
    edge = F.xxhash64("fp", "key").alias("edge")
    edges = found.where("whole").unionByName(single).select(edge, "tail", "tip", "size").dropDuplicates(["edge"])
    paths = store.keep(compacted(store.keep(edges, "distinct"), store), "unitigs")
    placed = again.join(classes.where("n > 1").select("fp", "sx"), ["fp", "sx"], "left_semi").select("id", "th", "first", "last", F.xxhash64("fp", "sx").alias("edge"))
    placed = placed.unionByName(single.select("id", "th", F.col("at").alias("first"), F.col("at").alias("last"), edge))
    spans = store.keep(path_spans(placed, paths), "occurrences")
    for table in (again, classes, found, single, paths):
        store.drop(table)
    done = store.keep(settled(spans, docs, store, length), "spans")
    store.drop(spans)
    return done


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = False, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Remove each word that a `length`-word window which also starts elsewhere covers.

    One row per input row: id_col, n_words, n_removed, kept_sha256 (of the kept words
    joined by one space) and, if keep_text, `kept_text`: the text itself where nothing
    goes, else the kept words joined by one space. Words are `[^\\x20\\x09-\\x0D]+`;
    null, empty and blank texts have none; shorter texts keep all of theirs. Equal
    rows are copies of each other. Ids may be null or repeat. Of the other columns only
    those in `keep` are read; they follow unchanged.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    store = Store(spark, "debruijn")
    docs = W.keyed(docs, id_col, text_col, keep)
    ranges = repeated_spans(docs.select("id", "th", "text"), store, length)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out, has = [], batch["ranges"].is_valid().to_pylist()
            for i, text in enumerate(batch["text"].cast(pa.large_binary())):
                data = text.as_py()
                words, gone = (data or b"").split(), 0
                if has[i]:
                    away = W.covered(batch["ranges"][i].values, len(words), length)
                    gone = int(away.sum())
                    words_kept = list(compress(words, (~away).tolist()))
                else:
                    words_kept = words
                joined = b" ".join(words_kept)
                out.append((len(words), gone, hashlib.sha256(joined).hexdigest(), (joined if gone else data) if keep_text else None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            arrays = [batch["id"], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + ([batch["rest"]] if keep else []), names=["id", "n_words", "n_removed", "kept_sha256", "kept_text"] + ["rest"] * bool(keep))

    told = W.with_ranges(docs, ranges)
    rest = f", rest {told.schema['rest'].dataType.simpleString()}" if keep else ""
    done = told.mapInArrow(cut, "id long, n_words long, n_removed long, kept_sha256 string, kept_text string" + rest)
    own = [F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text
    return done.select(*own, *(["rest.*"] if keep else []))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    return substring_dedup(documents(spark, sf_dir))
