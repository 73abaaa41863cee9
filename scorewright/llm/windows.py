"""Which fixed-length windows of the texts start anywhere else as well, without a row per window.

Windows are gathered by their minimizer (rolling.super_windows): runs of windows
of one document that share one are a row with a hash of the minimizer (`fp`) and
of the whole stretch (`sx`). Equal windows have equal `fp`, so

* rows whose `fp` stands alone are done with: nothing of them repeats;
* rows with one (`fp`, `sx`) are equal throughout: all of their windows repeat;
* for the rest, one representative of each class is compared with the other
  classes of its `fp` in short runs of windows: runs with an equal stretch repeat
  throughout, runs whose common middle stands alone repeat nowhere, and only where
  the middle is shared but the stretch is not are single windows compared.

Windows that share `fp` are told apart by one more 64-bit hash, of the window or of the
stretch; within the rows of one `fp` that is what equality rests on. Counting uses partial
aggregates and the rest are equi-joins, so very frequent stretches are never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm import rolling as R
from scorewright.llm.common import Store

ROW = "id long, th long, first int, last int, off int, fp long, sx long"


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """id, th, text and, in the struct `rest`, columns to keep. `th` tells apart rows that share an id; rows equal in both are copies."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"), *([F.struct(*keep).alias("rest")] if keep else []))


class Symbols:
    """Symbol sequence of a chunk: its bytes, or its words."""

    def __init__(self, chunk: R.Chunk, unit: str):
        if unit == "bytes":
            self.hash, self.offsets = R.byte_symbols(chunk.data), chunk.offsets
        else:
            words = R.Words(chunk)
            self.hash, self.offsets, self.start, self.end = words.hash, words.offsets, words.start, words.end

    def ends(self) -> np.ndarray:
        return np.repeat(self.offsets[1:], np.diff(self.offsets))


def super_rows(docs: DataFrame, unit: str, length: int, k: int, lead: bool = False) -> DataFrame:
    """Rows of window runs of `docs` (id, th, text). With `lead` (of bytes), also the k bytes from the minimizer on."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = batch["id"], batch["th"]
            for chunk in R.chunks(batch["text"]):
                sym = Symbols(chunk, unit)
                got = R.super_windows(R.Poly(sym.hash), sym.ends(), length, k)
                if not len(got["first"]):
                    continue
                doc = np.searchsorted(sym.offsets, got["first"], side="right") - 1
                base, row = sym.offsets[doc], pa.array(doc + chunk.lo)
                cols = [ids.take(row), ths.take(row), *(pa.array(x.astype(np.int32)) for x in (got["first"] - base, got["last"] - base, got["anchor"] - got["first"])), pa.array(R.signed(got["fp"])), pa.array(R.signed(got["sx"]))]
                names = ["id", "th", "first", "last", "off", "fp", "sx"]
                if lead:
                    raw = np.ascontiguousarray(chunk.data[got["anchor"][:, None] + np.arange(k)])
                    cols.append(pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(0, raw.size + 1, k, dtype=np.int32)), pa.py_buffer(raw)]))
                    names.append("lead")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(task, ROW + ", lead binary" * lead)


def alike(keys: DataFrame) -> DataFrame:
    """Keys to join by a shuffle, few or many: they grow with the rows, and a small input should cost as a large one does."""
    return keys.hint("merge")


def repeated_rows(rows: DataFrame, store: Store) -> DataFrame:
    """Rows whose minimizer stands elsewhere too.

    Here as below, the keys that recur are written before rows meet them: a join of two
    tables, unlike one with an aggregate, can be split where a key is frequent.
    """
    often = store.keep(rows.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp"), "often")
    return rows.join(alike(often), "fp", "left_semi")


def classes_of(rows: DataFrame, store: Store) -> DataFrame:
    """One row per class of equal stretches: how many, and the least place as its representative."""
    classes = store.keep(rows.groupBy("fp", "sx").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "first", "last", "off")).alias("rep")), "counted")
    kinds = store.keep(classes.groupBy("fp").agg(F.count("*").alias("kinds")), "kinds")
    return classes.join(alike(kinds), "fp").select("fp", "sx", "n", "kinds", "rep.*")


#: Windows of a run that is compared as one.
RUN = 16


def with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Documents (id, th, text) that have a list (id, th, runs), with it."""
    source = docs.withColumnsRenamed({"id": "id_", "th": "th_"})
    return source.join(lists, source["id_"].eqNullSafe(lists["id"]) & (source["th_"] == lists["th"])).select("id", "th", "text", "runs")


def _spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches of these sizes, one after another: the stretch of each element and its place in it."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)


def _listed(batch: pa.RecordBatch, chunk: R.Chunk, unit: str) -> tuple[Symbols, R.Poly, pa.StructArray, np.ndarray]:
    """Symbols and hashes of a chunk, its documents' list entries, and the document of each entry."""
    sym = Symbols(chunk, unit)
    own = batch["runs"].slice(chunk.lo, chunk.hi - chunk.lo)
    return sym, R.Poly(sym.hash), own.flatten(), np.repeat(np.arange(chunk.hi - chunk.lo), own.value_lengths().to_numpy())


def short_runs(classes: DataFrame, docs: DataFrame, unit: str, length: int) -> DataFrame:
    """Runs of at most RUN windows of the representatives of classes that have others of their `fp` beside them.

    Columns: id, th, at (first window), count (windows), n (of the class), fp, whole
    (hash of the stretch), core (hash of what all windows of a full run at this place
    have in common). Runs are cut at distances from the minimizer, so equal windows lie
    in runs with equal cores.
    """
    wanted = classes.where("kinds > 1").groupBy("id", "th").agg(F.collect_list(F.struct("first", "last", "off", "fp", "n")).alias("runs"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in R.chunks(batch["text"]):
                sym, poly, flat, doc = _listed(batch, chunk, unit)
                first, last, off, fp, n = (flat.field(c).to_numpy() for c in ("first", "last", "off", "fp", "n"))
                which, nth = _spread(last - first + 1)
                at = nth + first[which]
                away = first[which] + off[which] - at  # from the window's start to the minimizer
                block = away // RUN
                head = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (block[1:] != block[:-1])))) if len(which) else which
                count = np.diff(np.concatenate((head, [len(which)])))
                which, at, away, block = which[head], at[head], away[head], block[head]
                salt = R.mix(fp.view(np.uint64)[which])
                start = sym.offsets[doc[which]] + at
                tag = R.mix((block.astype(np.uint64) << np.uint64(32)) | (away % RUN * RUN + count).astype(np.uint64))
                whole = R.mix(poly.of(start, start + count - 1 + length) ^ salt ^ tag)
                low = start + away - RUN * block  # the last start of a full run here
                core = R.mix(poly.of(low, low - RUN + 1 + length) ^ salt ^ R.mix(block.astype(np.uint64)))
                row = pa.array(doc[which] + chunk.lo)
                yield pa.RecordBatch.from_arrays([batch["id"].take(row), batch["th"].take(row), pa.array(at.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(n[which]), pa.array(fp[which]), pa.array(R.signed(whole)), pa.array(R.signed(core))], names=["id", "th", "at", "count", "n", "fp", "whole", "core"])

    return with_lists(docs, wanted).mapInArrow(task, "id long, th long, at int, count int, n long, fp long, whole long, core long")


def single_windows(runs: DataFrame, docs: DataFrame, unit: str, length: int) -> DataFrame:
    """Each window of the runs with its hash: id, th, at, n, core, whole, key."""
    wanted = runs.groupBy("id", "th").agg(F.collect_list(F.struct("at", "count", "n", "fp", "whole", "core")).alias("runs"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in R.chunks(batch["text"]):
                sym, poly, flat, doc = _listed(batch, chunk, unit)
                first, count, fp = (flat.field(c).to_numpy() for c in ("at", "count", "fp"))
                which, nth = _spread(count)
                at = nth + first[which]
                place = sym.offsets[doc[which]] + at
                key = R.mix(poly.of(place, place + length) ^ R.mix(fp.view(np.uint64)[which]))
                row, pick = pa.array(doc[which] + chunk.lo), pa.array(which)
                yield pa.RecordBatch.from_arrays([batch["id"].take(row), batch["th"].take(row), pa.array(at.astype(np.int32)), *(flat.field(c).take(pick) for c in ("n", "core", "whole")), pa.array(R.signed(key))], names=["id", "th", "at", "n", "core", "whole", "key"])

    return with_lists(docs, wanted).mapInArrow(task, "id long, th long, at int, n long, core long, whole long, key long")


def shared_ranges(runs: DataFrame, docs: DataFrame, store: Store, unit: str, length: int) -> DataFrame:
    """Windows of single classes (n = 1) that another class has too: id, th, first, last."""
    kinds = store.keep(runs.groupBy("core", "whole").agg(F.sum("n").alias("copies")), "stretches")
    full = runs.where("n = 1").join(alike(kinds.where("copies > 1").select("core", "whole")), ["core", "whole"], "left_semi").select("id", "th", F.col("at").alias("first"), (F.col("at") + F.col("count") - 1).alias("last"))
    cores = store.keep(kinds.groupBy("core").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).where("kinds > 1 and least = 1").select("core"), "cores")
    opened = store.keep(runs.join(alike(cores), "core", "left_semi"), "opened")
    single = store.keep(single_windows(opened, docs, unit, length), "windows")
    twice = store.keep(single.groupBy("core", "key").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b").select("core", "key"), "twice")
    some = single.where("n = 1").join(alike(twice), ["core", "key"], "left_semi").select("id", "th", F.col("at").alias("first"), F.col("at").alias("last"))
    return full.unionByName(some)


def shared_windows(windows: DataFrame, store: Store) -> DataFrame:
    """Windows of representatives whose content another class has too."""
    twice = store.keep(windows.groupBy("key", "fp").agg(F.count("*").alias("c")).where("c > 1").select("key", "fp"), "twice")
    return windows.join(alike(twice), ["key", "fp"], "left_semi")


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Documents with the list of their ranges (first, last: window starts that repeat)."""
    # equal rows have equal ranges: told once, they go to each of them
    lists = ranges.distinct().groupBy("id", "th").agg(F.collect_list(F.struct("first", "last")).alias("ranges")).withColumnsRenamed({"id": "id_", "th": "th_"})
    return docs.join(lists, docs["id"].eqNullSafe(lists["id_"]) & (docs["th"] == lists["th_"]), "left").drop("th", "id_", "th_")


def covered(ranges, n: int, length: int) -> np.ndarray:
    """Which of n symbols some window of the ranges covers."""
    first, last = ranges.field("first").to_numpy(), ranges.field("last").to_numpy()
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, first, 1)
    np.add.at(delta, last + length, -1)
    return np.cumsum(delta[:-1]) > 0
