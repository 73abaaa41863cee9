"""Exact long-match removal over bytes, with a logarithmic family of sampled suffix arrays.

A batch's suffix array holds the suffixes that start at window minimizers, in the order
of their first `k` bytes. Any `length`-byte match has a sampled suffix at the same place on
both sides, with at least `k` equal bytes, so both stand next to each other in order, with
a longest common prefix of `k` or more. Arrays are kept in blocks of packed rows. A new
batch is merge-scanned against each level: blocks of both come by their first key, two
sorted runs are merged as they come, and neighbours with a long common prefix are
told. Arrays of equal size are merged in the same way, so n batches make at most log2(n) + 1
levels and a suffix is rewritten log2(n) times. What the scans find is then compared
window by window.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import windows as W
from scorewright.llm.common import Store, arrow_batches, documents

LENGTH = 400
#: Suffixes of a block, and bytes of suffixes that a range of keys should hold.
BLOCK, RANGE_BYTES = 1 << 15, 16 << 20
#: Most ranges of keys, and keys drawn for each to tell where they part; at 108 bytes a key, no more than 7 MB are sent to tasks.
RANGES, DRAWN = 1 << 16, 4
#: The draw reads pieces of so many code points, which hold about so many times the keys that are drawn.
PIECE, SPARE = 1 << 13, 256
_LISTS = {"id": "array<long>", "th": "array<long>", "first": "array<int>", "last": "array<int>", "off": "array<int>", "fp": "array<long>", "sx": "array<long>", "hit": "array<boolean>"}
PACKED = "top int, least binary, n int, keys binary, " + ", ".join(f"{c} {t}" for c, t in _LISTS.items())


class Run:
    """Suffixes in order: keys (the first k bytes, then eight that tell equal ones apart) and what is known of each."""

    def __init__(self, keys: np.ndarray, columns: dict[str, np.ndarray]):
        self.keys, self.columns = keys, columns

    def __len__(self) -> int:
        return len(self.keys)

    def part(self, a: int, z: int) -> Run:
        return Run(self.keys[a:z], {c: v[a:z] for c, v in self.columns.items()})

    def leads(self, k: int) -> np.ndarray:
        return np.ascontiguousarray(self.keys).view(np.uint8).reshape(len(self), -1)[:, :k]

    @classmethod
    def joined(cls, parts: list[Run]) -> Run:
        return cls(np.concatenate([p.keys for p in parts]), {c: np.concatenate([p.columns[c] for p in parts]) for c in parts[0].columns})

    @classmethod
    def merged(cls, a: Run, b: Run) -> Run:
        """Two runs in one order, without sorting: each finds its places among the other's keys."""
        at = np.arange(len(a)) + np.searchsorted(b.keys, a.keys, "left")
        bt = np.arange(len(b)) + np.searchsorted(a.keys, b.keys, "right")

        def both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = np.empty(len(x) + len(y), x.dtype)
            out[at], out[bt] = x, y
            return out

        return cls(both(a.keys, b.keys), {c: both(v, b.columns[c]) for c, v in a.columns.items()})


def common_prefixes(leads: np.ndarray) -> np.ndarray:
    """Of each lead but the first, how many bytes it shares with the one before."""
    same = leads[1:] == leads[:-1]
    return np.where(same.all(axis=1), leads.shape[1], same.argmin(axis=1))


def _grouped(leads: np.ndarray) -> np.ndarray:
    """Number of the group of neighbours that share all of their leads."""
    new = common_prefixes(leads) < leads.shape[1] if len(leads) else np.zeros(0, bool)
    return np.cumsum(np.concatenate((np.zeros(min(1, len(leads)), bool), new)))


def _packed(run: Run, top: int) -> pa.RecordBatch:
    c = run.columns
    arrays = [pa.array([top], pa.int32()), pa.array([run.keys[0].ljust(run.keys.itemsize, b"\0")], pa.binary()), pa.array([len(run)], pa.int32()), pa.array([run.keys.tobytes()], pa.binary())]
    one = np.array([0, len(run)], np.int32)
    arrays += [pa.ListArray.from_arrays(one, pa.array(c[name], mask=~c["valid"] if name == "id" else None)) for name in _LISTS]
    return pa.RecordBatch.from_arrays(arrays, names=["top", "least", "n", "keys", *_LISTS])


def _unpacked(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, Run]]:
    """(range, side, run) of each block."""
    for i in range(batch.num_rows):
        row = batch.slice(i, 1)
        lists = {c: row[c].flatten() for c in _LISTS}
        columns = {c: lists[c].fill_null(0).to_numpy() if c == "id" else lists[c].to_numpy(zero_copy_only=False) for c in _LISTS} | {"valid": lists["id"].is_valid().to_numpy(zero_copy_only=False)}
        side = int(row["side"][0].as_py()) if "side" in batch.schema.names else 0
        yield row["top"][0].as_py(), side, Run(np.frombuffer(row["keys"][0].as_py(), f"S{width}"), columns)


def _rows(run: Run, which: np.ndarray) -> pa.RecordBatch:
    """Window runs of some suffixes."""
    c = {n: v[which] for n, v in run.columns.items()}
    return pa.RecordBatch.from_arrays([pa.array(c["id"], mask=~c["valid"]), *(pa.array(c[n]) for n in ("th", "first", "last", "off", "fp", "sx"))], names=["id", "th", "first", "last", "off", "fp", "sx"])


def _blocks(run: Run, top: int, shared: np.ndarray, k: int, last: bool) -> Iterator:
    """Packed blocks of a run with their neighbours marked; unless it is the last of its range, its last group is left over as a run."""
    leads = run.leads(k)
    group = _grouped(leads)
    begins = np.flatnonzero(np.concatenate(([True], np.diff(group) > 0)))
    # a lead that parts two ranges may have others in the next one
    listed = np.isin(_as_keys(leads[begins]), shared)
    run.columns["hit"] = run.columns["hit"] | (np.bincount(group)[group] > 1) | listed[group]
    stop = len(run) if last else len(run) - 1 if listed[-1] else int(begins[-1])
    for a in range(0, stop, BLOCK):
        yield _packed(run.part(a, min(stop, a + BLOCK)), top)
    if not last:
        yield run.part(stop, len(run))


class SuffixIndex:
    """Levels of suffix arrays; add() takes batches of documents (id, th, text)."""

    def __init__(self, store: Store, length: int = LENGTH, size: int = 0):
        """`size`: bytes of all texts to come, about; it sets into how many ranges keys are cut."""
        self.store, self.length, self.k = store, length, length // 4
        self.width = self.k + 8
        self.suffixes = 2 * size / (length - self.k + 2)
        self.ranges = max(1, min(RANGES, math.ceil(self.suffixes * (self.width + 44) / RANGE_BYTES)))
        self.cuts: np.ndarray | None = None
        self.levels: list[tuple[int, DataFrame]] = []
        self.marked: list[DataFrame] = []
        self.found: list[DataFrame] = []

    def part(self, docs: DataFrame) -> None:
        """Tell where ranges part by all documents to come; without this the first batch tells.

        Copies of a text are in one batch, and where there are many, each of their leads fills
        ranges by itself: these part only if keys of that batch are drawn too.
        """
        if self.ranges == 1:
            return
        most, text = max(PIECE, 8 * self.length), F.col("text")
        share = min(1.0, SPARE * DRAWN * self.ranges / max(1, self.suffixes))
        chosen = lambda p: F.pmod(F.xxhash64(F.lit(5), "id", "th", p), F.lit(1 << 20)) < math.ceil(share * (1 << 20))
        ends = F.floor(F.greatest(F.char_length(text) - 1, F.lit(0)) / most).cast("int")
        pieces = docs.select("id", "th", F.explode(F.transform(F.filter(F.sequence(F.lit(0), ends), chosen), lambda p: text.substr(p * most + 1, F.lit(most)))).alias("text"))
        drawn = self.store.keep(W.super_rows(pieces, "bytes", self.length, self.k, lead=True), "drawn")
        cuts = self._cuts(self._keyed(drawn))
        self.cuts = cuts if len(cuts) else None
        self.store.drop(drawn)

    def add(self, docs: DataFrame, last: bool = False) -> None:
        """Index a batch and scan it against the levels. After the last one levels stay as they are, as no batch will meet them."""
        raw = self.store.keep(W.super_rows(docs, "bytes", self.length, self.k, lead=True), "batch")
        array, size = self._built(raw), 1
        self.store.drop(raw)
        # rows that a batch marks are told once; scans tell others, which are alone in their batch
        self.marked.append(self.store.keep(array.mapInArrow(self._hits(), W.ROW), "marked"))
        for _, level in self.levels:
            self.found.append(self.store.keep(self._side_by_side(array, level).mapInArrow(self._merging(scan=True), W.ROW), "found"))
        while not last and self.levels and self.levels[-1][0] == size:
            _, level = self.levels.pop()
            both = self.store.keep(self._side_by_side(array, level).mapInArrow(self._merging(scan=False), PACKED), "level")
            self.store.drop(array)
            self.store.drop(level)
            array, size = both, 2 * size
        self.levels.append((size, array))

    def _tasks(self) -> int:
        spark = self.store.spark
        return min(self.ranges, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))

    def _keyed(self, raw: DataFrame) -> DataFrame:
        tie = F.unhex(F.lpad(F.hex(F.xxhash64("id", "th", "first")), 16, "0"))
        return raw.withColumn("key", F.concat("lead", tie)).drop("lead")

    def _cuts(self, keyed: DataFrame) -> np.ndarray:
        """Keys at which ranges part, from a bounded draw by a hash of where they stand."""
        share = min(1.0, DRAWN * self.ranges / max(1, keyed.count()))
        drawn = keyed.where(F.pmod(F.xxhash64(F.lit(3), "id", "th", "first"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("key").orderBy("key").collect()
        keys = np.array([bytes(r["key"]) for r in drawn], f"S{self.width}")
        return keys[np.linspace(0, len(keys), self.ranges + 1)[1:-1].astype(int)] if len(keys) else keys

    def _built(self, raw: DataFrame) -> DataFrame:
        """The suffix array of a batch, in blocks; suffixes whose neighbour has the same lead are marked."""
        keyed = self._keyed(raw)
        if self.cuts is None:
            self.cuts = self._cuts(keyed)
        cuts, width, k = self.cuts, self.width, self.k
        shared = _cut_leads(cuts, k)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = _keys(batch["key"], width)
                yield batch.append_column("top", pa.array(np.searchsorted(cuts, keys, "right").astype(np.int32)))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, None
            for batch in batches:
                top, run = batch["top"].to_numpy(), _run(batch, width)
                ends = [*np.flatnonzero(np.diff(top)) + 1, len(top)] if len(top) else []
                a = 0
                for z in ends:
                    if held is not None and top[a] != now:
                        yield from _blocks(held, now, shared, k, last=True)
                        held = None
                    part = run.part(a, z)
                    held, now, a = part if held is None else Run.joined([held, part]), int(top[a]), z
                    if len(held) > 2 * BLOCK:
                        *whole, rest = _blocks(held, now, shared, k, last=False)
                        yield from whole
                        held = rest
            if held is not None:
                yield from _blocks(held, now, shared, k, last=True)

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields)
        placed = keyed.mapInArrow(place, f"{schema}, top int")
        return self.store.keep(placed.repartition(self._tasks(), "top").sortWithinPartitions("top", "key").mapInArrow(pack, PACKED), "level")

    def _hits(self):
        width = self.width

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, run in _unpacked(batch, width):
                    yield _rows(run, np.flatnonzero(run.columns["hit"]))

        return task

    def _side_by_side(self, array: DataFrame, level: DataFrame) -> DataFrame:
        """Blocks of two arrays by range and first key."""
        both = array.withColumn("side", F.lit(0)).unionByName(level.withColumn("side", F.lit(1)))
        return both.repartition(self._tasks(), "top").sortWithinPartitions("top", "least", "side")

    def _merging(self, scan: bool):
        """Task: merges the two sides of each range as their blocks come. A scan tells suffixes that share their lead with one of the other side; a merge gives the blocks of both."""
        width, k, shared = self.width, self.k, _cut_leads(self.cuts, self.k)

        def done(run: Run, top: int) -> Iterator[pa.RecordBatch]:
            if not len(run):
                return
            if scan:
                group = _grouped(run.leads(k))
                sides = np.zeros((2, group[-1] + 1), bool)
                sides[run.columns["side"], group] = True
                which = np.flatnonzero(sides.all(axis=0)[group] & ~run.columns["hit"])
                if len(which):
                    yield _rows(run, which)
                return
            group = _grouped(run.leads(k))
            run.columns["hit"] = run.columns["hit"] | (np.bincount(group)[group] > 1)
            for a in range(0, len(run), BLOCK):
                yield _packed(run.part(a, a + BLOCK), top)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, None
            for batch in batches:
                for top, side, run in _unpacked(batch, width):
                    run.columns["side"] = np.full(len(run), side, np.int8)
                    if held is not None and top != now:
                        yield from done(held, now)
                        held = None
                    now = top
                    if held is None:
                        held = run
                        continue
                    # what lies before the new block's first lead is settled: no later block begins before it
                    lead = run.leads(k)[:1]
                    bar = run.keys[0] if np.isin(_as_keys(lead), shared)[0] else _as_keys(np.concatenate((lead, np.zeros((1, 8), np.uint8)), axis=1))[0]
                    cut = int(np.searchsorted(held.keys, bar, "left"))
                    yield from done(held.part(0, cut), now)
                    held = Run.merged(held.part(cut, len(held)), run)
            if held is not None:
                yield from done(held, now)

        return task

    def candidates(self) -> DataFrame:
        """Window runs of the suffixes that stand next to one with the same lead: those of one batch, repeated rows each, and those that scans found, however often, once."""
        parts = [self._union(x) for x in (self.marked, self.found) if x]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1].distinct())

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out


def _as_keys(leads: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(leads).view(f"S{leads.shape[1]}").ravel() if len(leads) else np.zeros(0, f"S{leads.shape[1]}")


def _cut_leads(cuts: np.ndarray, k: int) -> np.ndarray:
    """Leads at which ranges part: suffixes with them may lie in two ranges."""
    return np.unique(cuts.astype(f"S{k}"))


def _keys(column: pa.Array, width: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(f"S{width}") if len(column) else np.zeros(0, f"S{width}")


def _run(batch: pa.RecordBatch, width: int) -> Run:
    columns = {c: batch[c].to_numpy() for c in ("th", "first", "last", "off", "fp", "sx")}
    ids = batch["id"]
    columns |= {"id": ids.fill_null(0).to_numpy(), "valid": ids.is_valid().to_numpy(zero_copy_only=False), "hit": np.zeros(batch.num_rows, bool)}
    return Run(_keys(batch["key"], width), columns)


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, batches: int = 4, keep_bytes: bool = False) -> DataFrame:
    """Remove each byte that a `length`-byte string which also starts elsewhere covers.

    One row per input row: id_col, n_bytes, n_removed, n_spans, kept_sha256 (and
    `kept` with the remaining bytes if keep_bytes). Null and empty texts have no
    bytes; texts shorter than `length` keep all of theirs. A row repeated whole is
    a copy like any other. Ids may be null or repeat. Other columns are not read.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    store = Store(spark, "suffix")
    docs = W.keyed(docs, id_col, text_col)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    index = SuffixIndex(store, length, size)
    index.part(docs)
    for b in range(batches):
        index.add(docs.where(F.pmod(F.col("th"), F.lit(batches)) == b), last=b == batches - 1)
    for _, level in index.levels:
        store.drop(level)
    rows = store.keep(index.candidates(), "candidates")
    for found in (*index.marked, *index.found):
        store.drop(found)
    ranges = repeated_ranges(rows, docs, store, "bytes", length)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out = []
            for i, text in enumerate(batch["text"].cast(pa.large_binary())):
                data, spans, gone = text.as_py() or b"", 0, 0
                if batch["ranges"].is_valid()[i].as_py():
                    away = W.covered(batch["ranges"][i].values, len(data), length)
                    gone, spans = int(away.sum()), int(away[0]) + int(np.count_nonzero(away[1:] & ~away[:-1]))
                    kept = np.frombuffer(data, np.uint8)[~away].tobytes()
                else:
                    kept = data
                out.append((len(data), gone, spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            arrays = [batch["id"], *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = W.with_ranges(docs, ranges).mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)
    return done if keep_bytes else done.drop("kept")


def repeated_ranges(rows: DataFrame, docs: DataFrame, store: Store, unit: str, length: int) -> DataFrame:
    """Window starts that repeat (id, th, first, last) among candidate rows, whose table goes when they are found."""
    classes = store.keep(W.classes_of(rows, store), "classes")
    whole = rows.join(W.alike(classes.where("n > 1").select("fp", "sx")), ["fp", "sx"], "left_semi").select("id", "th", "first", "last")
    runs = store.keep(W.short_runs(classes, docs, unit, length), "runs")
    ranges = store.keep(whole.unionByName(W.shared_ranges(runs, docs, store, unit, length)), "ranges")
    for table in (rows, classes, runs):
        store.drop(table)
    return ranges


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    return suffix_dedup(documents(spark, sf_dir))
