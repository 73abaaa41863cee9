"""MinHash near-duplicates: universal hash minima, banding, signature verification, components.

Documents with equal shingle sets form a class and only one of each class is
compared. Within a band bucket every member is first compared with one hub; what
is still in different components after that is compared in blocks inside tasks.
For small buckets the tasks emit pairs whose signatures are alike, to be confirmed
on the full sets; for larger ones the blocks carry the full sets, and only links
are emitted. No pairs of a whole bucket are ever made, and every pair that shares a
band and is not yet connected is tested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import rolling as R
from scorewright.llm.common import Store, arrow_batches, documents
from scorewright.llm.components import components

ROWS = 6
BANDS = 42
#: Members of a bucket that one task compares with as many others.
BLOCK = 128
#: Buckets of more members are compared on full sets where they stand.
SMALL = 16
_SEED = 20_240_601


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingle hashes) for each text of a batch."""
    for chunk in R.chunks(texts):
        words = R.Words(chunk, lower=True)
        poly = R.Poly(words.hash)
        for i in range(chunk.hi - chunk.lo):
            a, b = int(words.offsets[i]), int(words.offsets[i + 1])
            if b == a:
                yield chunk.lo + i, np.zeros(0, np.uint64)
            elif b - a < width:
                yield chunk.lo + i, poly.of(np.array([a]), np.array([b]))
            else:
                starts = np.arange(a, b - width + 1)
                yield chunk.lo + i, np.unique(poly.of(starts, starts + width))


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each universal hash a*x+b modulo 2**32 over the shingles."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 512):
        np.minimum(best, (x[lo : lo + 512, None] * a + b).min(axis=0), out=best)
    return best


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    keys = np.arange(len(sig) // rows, dtype=np.uint64)
    for col in sig.reshape(-1, rows).T:
        keys = R.mix(keys * np.uint64(31) + col.astype(np.uint64) + np.uint64(1))
    return keys.view(np.int64)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows) if rows else [], kind))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, threshold: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Near-duplicate component of every document.

    Returns one row per input row: id_col, n_shingles, component_id, kept. Sets are
    distinct `width`-word shingles of the lower-cased (A-Z) words; a shorter text is
    one shingle; a null, empty or blank text has none and is linked with nothing.
    Texts are linked where 100 * intersection >= threshold * union on the full sets.
    Rows with one id are one node: an id that stands in several classes ties them. A
    null id is linked with nothing: its component is null and it is kept. Other columns
    of the input are not read.

    A pair at the threshold shares no band with probability (1 - 0.8**6)**42, three
    in a million, and has too few equal minima for the check of signatures with another
    four in a million (4.5 standard deviations); more bands make both smaller.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    store = Store(spark, "minhash")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    a, b = coefficients(rows * bands)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, keys = [], [], []
            for _, s in shingle_sets(batch["text"], width):
                n.append(len(s))
                digest.append(_digest(s))
                keys.append(band_keys(minima(s, a, b), rows) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array([d[0] for d in digest], pa.int64()), pa.array([d[1] for d in digest], pa.int64()), _lists(keys, pa.int64())], names=["id", "n", "h1", "h2", "bands"])

    members = store.keep(docs.mapInArrow(sketch, "id long, n long, h1 long, h2 long, bands array<long>"), "members")
    classes = store.keep(members.where("n > 0 and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("cls"), F.first("bands").alias("bands")), "classes")
    placed = classes.select("cls", F.posexplode("bands").alias("band", "key"))
    # recurring keys are written before rows meet them: joins of two tables can be split at a frequent key
    shared = store.keep(placed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    buckets = store.keep(placed.join(shared, "key"), "buckets")

    # One hub for each bucket: the member that lies in the fullest buckets.
    weight = buckets.groupBy("cls").agg(F.sum("size").alias("weight"))
    hubs = store.keep(buckets.join(weight, "cls").groupBy("key").agg(F.max(F.struct("weight", (-F.col("cls")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("hub")), "hubs")
    stars = buckets.join(hubs, "key").where("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct()

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, sets = [], []
            for _, s in shingle_sets(batch["text"], width):
                sigs.append((minima(s, a, b) & np.uint32(0xFFFF)).astype("<u2").tobytes())
                sets.append(s.view(np.int64))
                if sum(map(len, sets)) > 1 << 20:
                    done = len(sets)
                    ids = batch["id"].slice(0, done)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(sigs, pa.binary()), _lists(sets, pa.int64())], names=["cls", "sig", "set"])
                    batch, sigs, sets = _rest(batch, done), [], []
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(sigs, pa.binary()), _lists(sets, pa.int64())], names=["cls", "sig", "set"])

    involved = buckets.select(F.col("cls").alias("id")).distinct()
    sets = store.keep(docs.join(involved, "id", "left_semi").mapInArrow(full, "cls long, sig binary, set array<long>"), "sets")
    least = _least_alike(rows * bands, threshold)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = _equal_lanes(batch["sa"], batch["sb"], rows * bands) >= least
            yield batch.select(["a", "b"]).filter(pa.array(same))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs whose signatures, then full sets, are similar enough."""
        one, two = sets.select(F.col("cls").alias("a"), F.col("sig").alias("sa")), sets.select(F.col("cls").alias("b"), F.col("sig").alias("sb"))
        return exact(pairs.join(one, "a").join(two, "b").mapInArrow(alike, "a long, b long"))

    def exact(pairs: DataFrame) -> DataFrame:
        one, two = sets.select(F.col("cls").alias("a"), F.col("set").alias("xa")), sets.select(F.col("cls").alias("b"), F.col("set").alias("xb"))
        both = F.size(F.array_intersect("xa", "xb"))
        return pairs.join(one, "a").join(two, "b").where(100 * both >= threshold * (F.size("xa") + F.size("xb") - both)).select("a", "b")

    links = store.keep(confirmed(stars).unionByName(_ties(members, classes)), "links")
    comp = store.keep(components(links, store), "components")
    few, many = _unsettled(buckets, comp, sets, rows, bands, least, threshold, store.keep)
    more = store.keep(exact(few).unionByName(many), "more")
    if not more.isEmpty():
        comp = store.keep(components(links.unionByName(more), store), "components")

    label = store.keep(classes.select("h1", "h2", "cls").join(comp, F.col("cls") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "cls").alias("component")), "labels")
    out = members.select("id", "n", "h1", "h2").join(label, ["h1", "h2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("component")), "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _ties(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between an id and each of the classes it stands in, where there are several."""
    some = members.where("n > 0 and id is not null")
    several = some.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")).where("x <> y").select("id")
    return some.join(several, "id", "left_semi").join(classes, ["h1", "h2"]).where("id <> cls").select(F.col("id").alias("a"), F.col("cls").alias("b")).distinct()


def _rest(batch: pa.RecordBatch, done: int) -> pa.RecordBatch:
    return batch.slice(done)


def _least_alike(lanes: int, threshold: int) -> int:
    """Equal minima below which a pair is out: 4.5 standard deviations under the threshold."""
    p = threshold / 100
    return int(lanes * (p - 4.5 * (p * (1 - p) / lanes) ** 0.5))


def _matrix(sigs, lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), "<u2").reshape(-1, lanes)


def _equal_lanes(left: pa.Array, right: pa.Array, lanes: int) -> np.ndarray:
    return (_matrix(left.to_pylist(), lanes) == _matrix(right.to_pylist(), lanes)).sum(axis=1)


def _counts_here(same: np.ndarray, rows: int, band: int) -> np.ndarray:
    """Of pairs that share `band`, by their equal lanes: those to be told in it, the first or the second band they seem to share.

    Signatures hold 16 bits of each minimum, so one band in tens of thousands seems shared
    and is not; were pairs told in the first only, such a pair would be told nowhere.
    """
    return same.reshape(len(same), same.shape[1] // rows, rows)[:, :band].all(axis=2).sum(axis=1) <= 1


def _unsettled(buckets: DataFrame, comp: DataFrame, sets: DataFrame, rows: int, bands: int, least: int, threshold: int, keep) -> tuple[DataFrame, DataFrame]:
    """Pairs of one bucket that lie in different components: those of small buckets with like signatures, and the links of larger ones.

    Each such pair has a member outside its bucket's most frequent component, so
    only those members are held against the bucket, block by block. A pair counts
    in the first two bands that it seems to share.
    """
    lanes = rows * bands
    at = buckets.join(comp, buckets["cls"] == comp["node"], "left").select("key", "band", "size", "cls", F.coalesce("component", "cls").alias("comp"))
    main = at.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", (-F.col("comp")).alias("minus"))).alias("top"), F.count("*").alias("kinds")).where("kinds > 1").select("key", (-F.col("top.minus")).alias("main"))
    main = keep(main, "main")
    at = at.join(main, "key").withColumn("block", F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / BLOCK).cast("long")))

    def paired(df: DataFrame, *columns: str) -> DataFrame:
        told = df.join(sets.select("cls", *columns), "cls")
        blocks = lambda part, tag: part.groupBy("key", "band", "block").agg(F.collect_list(F.struct("cls", "comp", *columns)).alias(tag)).drop("block")
        return blocks(told.where("comp <> main"), "x").join(blocks(told, "y").drop("band"), "key").select("band", "x", "y")

    def hits(batch: pa.RecordBatch) -> Iterator[tuple]:
        """(x members, y members, place in x, places in y that differ in component and have like signatures and are told in this band)."""
        for band, x, y in zip(batch["band"].to_pylist(), batch["x"], batch["y"], strict=True):
            x, y = x.values, y.values
            sx, sy = _matrix(x.field("sig").to_pylist(), lanes), _matrix(y.field("sig").to_pylist(), lanes)
            cx, cy = x.field("comp").to_numpy(), y.field("comp").to_numpy()
            for i in range(len(sx)):
                same = sy == sx[i]
                hit = np.flatnonzero((same.sum(axis=1) >= least) & (cy != cx[i]))
                hit = hit[_counts_here(same[hit], rows, band)]
                if len(hit):
                    yield x, y, i, hit

    def batch_of(left: list, right: list) -> pa.RecordBatch:
        a, b = (np.concatenate(side) if side else np.zeros(0, np.int64) for side in (left, right))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for x, y, i, hit in hits(batch):
                right.append(y.field("cls").to_numpy()[hit])
                left.append(np.full(len(hit), x.field("cls")[i].as_py()))
            yield batch_of(left, right)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for x, y, i, hit in hits(batch):
                own = x.field("set")[i].values.to_numpy()
                own = np.sort(own)
                others = y.field("set").take(pa.array(hit))
                sizes, flat = others.value_lengths().to_numpy(), others.flatten().to_numpy()
                found = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                both = np.add.reduceat(found, np.cumsum(sizes) - sizes, dtype=np.int64)
                hit = hit[100 * both >= threshold * (len(own) + sizes - both)]
                # one link to a component is enough
                hit = hit[np.unique(y.field("comp").to_numpy()[hit], return_index=True)[1]]
                right.append(y.field("cls").to_numpy()[hit])
                left.append(np.full(len(hit), x.field("cls")[i].as_py()))
            yield batch_of(left, right)

    few = paired(at.where(F.col("size") <= SMALL), "sig").mapInArrow(likely, "a long, b long")
    many = paired(at.where(F.col("size") > SMALL), "sig", "set").mapInArrow(linked, "a long, b long")
    return few.distinct(), many.distinct()


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return near_duplicates(documents(spark, sf_dir))
