"""Cross-entropy difference of documents between two matched bigram models.

The target model counts the documents that the labels mark as good, the background
model all documents. Both share one vocabulary (every word of the background, and one
place for unseen words), all bigrams and one smoothing:
P(w | v) = (c(v, w) + STRENGTH * P(w)) / (c(v) + STRENGTH), with
P(w) = (c(w) + 1) / (N + V). What follows a text's last word is its end, so c(v) counts
every v; before a text's first word stands its start. Every token of every document counts, nothing is pruned,
and no count is ever gathered in the driver: the tables grow with the corpus.

Documents are dealt by hash into blocks of about BLOCK_BYTES. A block counts its own
words and bigrams first, and asks for the corpus counts of its keys in packed rows, one
for each bucket of keys: sorted keys as short differences, counts in as few bytes as they
need. A bucket adds up what all blocks have and answers each block in the order of its
keys: which of them others have too, and the counts of those. A key has at most one entry a block, whatever its frequency, so
buckets are even. A block then scores its documents from the answers and its own counts.
Keys are 62-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import rolling as R
from scorewright.llm.common import Store, arrow_batches, documents

STRENGTH = 2.0
#: UTF-8 bytes of texts that are counted and scored together, and of those whose keys are added up together.
BLOCK_BYTES, BUCKET_BYTES = 7 << 20, 10 << 20
#: Ids of good documents that may be sent to all tasks (about 40 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Kinds of keys, in their low two bits; sums have kind 3.
BIGRAM, WORD = 0, 1
#: Keys of all documents that have a token, and of all tokens.
TEXTS, TOKENS = np.uint64(2**64 - 5), np.uint64(2**64 - 1)
#: A block's keys in a bucket, with its counts.
ASKED = "bucket int, block int, size int, first long, keys binary, n binary, g binary"
#: Which of those keys other blocks have too, and the sums of these. `words`: distinct words of the bucket, told once.
ANSWER = "bucket int, block int, size int, shared binary, n binary, g binary, words long"
_START = np.uint64(0x5157A27)


def _key(h: np.ndarray, kind: int) -> np.ndarray:
    return (R.mix(h + np.uint64(kind)) & ~np.uint64(3)) | np.uint64(kind)


def _few_bytes(values: np.ndarray, widths: tuple[int, ...] = (1, 2, 4, 6, 8)) -> bytes:
    """The values in as many bytes as the largest needs: all their low bytes, then the next, so that what is mostly zero lies together."""
    most = int(values.max()) if len(values) else 0
    width = next(w for w in widths if most >> (8 * w) == 0)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _values(raw: bytes, n: int) -> np.ndarray:
    """What _few_bytes() packed."""
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(-1, n).T
    return out.reshape(-1).view("<u8")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _asked(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, block, keys, n, g) of each row."""
    for bucket, block, size, first, keys, n, g in zip(*(batch[c].to_pylist() for c in ("bucket", "block", "size", "first", "keys", "n", "g")), strict=True):
        steps = np.concatenate((np.array([first], np.int64).view(np.uint64), _values(keys, size - 1)))
        yield bucket, block, np.cumsum(steps, dtype=np.uint64), _values(n, size), _values(g, size)


def _stretches(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of ascending keys."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])).tolist()
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[a]), a, z


class Keys:
    """Keys of a block's texts: word and pair of each token, which tokens begin a text, and how many each text has."""

    def __init__(self, texts: list[pa.Array]):
        words, pairs, first, sizes = [], [], [], []
        for text in texts:
            for chunk in R.chunks(text):
                w = R.Words(chunk, lower=True)
                prev = np.concatenate(([_START], w.hash[:-1]))[: len(w.hash)]
                begins = w.offsets[:-1][w.offsets[:-1] < w.offsets[1:]]
                prev[begins] = _START
                words.append(_key(w.hash, WORD))
                pairs.append(_key(R.mix(prev * np.uint64(R.BASE)) ^ w.hash, BIGRAM))
                starts = np.zeros(len(w.hash), bool)
                starts[begins] = True
                first.append(starts)
                sizes.append(np.diff(w.offsets))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.word, self.pair = join(words, np.uint64), join(pairs, np.uint64)
        self.first, self.sizes = join(first, bool), join(sizes, np.int64)

    def counted(self, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, with counts over all and over good texts."""
        token_good = np.repeat(good, self.sizes)
        keys, flags = np.concatenate((self.pair, self.word)), np.concatenate((token_good, token_good))
        names, where = np.unique(keys, return_inverse=True)
        n, g = np.bincount(where, minlength=len(names)), np.bincount(where, flags, len(names)).astype(np.int64)
        some = self.sizes > 0
        totals = np.array([[some.sum(), (good & some).sum()], [len(self.word), token_good.sum()]], np.int64)
        return np.concatenate((names, [TEXTS, TOKENS])), np.concatenate((n, totals[:, 0])), np.concatenate((g, totals[:, 1]))


class Counts:
    """Counts of a block's keys: the corpus's where other blocks have them too, else the block's own."""

    def __init__(self, own: tuple[np.ndarray, np.ndarray, np.ndarray], buckets: int, answers: list[pa.RecordBatch]):
        self.keys, self.counts = own[0], np.stack([own[2], own[1]]).astype(np.float64)
        where = {bucket: (a, z) for bucket, a, z in _stretches(self.keys, buckets)}
        for part in answers:
            for bucket, size, shared, n, g in zip(*(part[c].to_pylist() for c in ("bucket", "size", "shared", "n", "g")), strict=True):
                a, z = where[bucket]
                if z - a != size:
                    raise ValueError("a block's texts are not those that it asked for")
                at = a + np.flatnonzero(np.unpackbits(np.frombuffer(shared, np.uint8), count=size))
                self.counts[0, at], self.counts[1, at] = _values(g, len(at)), _values(n, len(at))

    def of(self, keys: np.ndarray) -> np.ndarray:
        """(model, key) counts; 0 for keys that are not there."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[:, at], 0.0)

    def losses(self, keys: Keys, vocabulary: int) -> np.ndarray:
        """(model, token) natural-log losses."""
        total, texts = self.of(np.array([TOKENS]))[:, 0], self.of(np.array([TEXTS]))[:, 0]
        word = self.of(keys.word)
        unigram = (word + 1.0) / (total[:, None] + vocabulary)
        context = np.roll(word, 1, axis=1)
        context[:, keys.first] = texts[:, None]
        return -np.log((self.of(keys.pair) + STRENGTH * unigram) / (context + STRENGTH))


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive rows with one value of `by`, as slices of the batches."""
    now, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch[by].to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(values)) + 1, [len(values)]))
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if parts and values[a] != now:
                yield parts
                parts = []
            now = values[a]
            parts.append(batch.slice(a, z - a))
    if parts:
        yield parts


def _flags(parts: list[pa.RecordBatch]) -> np.ndarray:
    return np.concatenate([p["good"].to_numpy(zero_copy_only=False).astype(bool) for p in parts])


def _asking(buckets: int):
    """Task: what each block has, in packed rows by bucket."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _groups(batches, "block"):
            keys, n, g = Keys([p["text"] for p in parts]).counted(_flags(parts))
            block, rows = parts[0]["block"][0].as_py(), []
            for bucket, a, z in _stretches(keys, buckets):
                rows.append((bucket, block, z - a, int(keys[a : a + 1].view(np.int64)[0]), _few_bytes(np.diff(keys[a:z])), _few_bytes(n[a:z]), _few_bytes(g[a:z])))
                if len(rows) == 256:
                    yield _batch(rows, ASKED)
                    rows = []
            yield _batch(rows, ASKED)

    return task


def _answering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: sums of each bucket, packed for each block that has a key which others have too."""
    for parts in _groups(batches, "bucket"):
        rows = [r for p in parts for r in _asked(p)]
        keys, n, g = (np.concatenate([r[c] for r in rows]) for c in (2, 3, 4))
        names, where, times = np.unique(keys, return_inverse=True, return_counts=True)
        words = int(np.count_nonzero((names & np.uint64(3)) == WORD))
        n, g = (np.bincount(where, x, len(names)).astype(np.uint64) for x in (n, g))
        shared, lo, out = times[where] > 1, 0, []
        for bucket, block, own, _, _ in rows:
            mine = slice(lo, lo + len(own))
            lo, at = lo + len(own), where[mine][shared[mine]]
            out.append((bucket, block, len(own), np.packbits(shared[mine]).tobytes(), _few_bytes(n[at]), _few_bytes(g[at]), words if not out and mine.start == 0 else 0))
            if len(out) == 256:
                yield _batch(out, ANSWER)
                out = []
        yield _batch(out, ANSWER)


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Train both models on `docs` and score every document; one row per input row.

    id_col, n_tokens, target_loss, background_loss, difference: mean losses of the tokens
    in nats, and target minus background (lower: more like the target). The target is
    made of documents whose id has label 1; rows with one id share its label. Null ids
    have none. A null, empty or blank text has no tokens and null losses. Rows equal in id
    and text lie in one block. Other columns are not read. Empty tables give none.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    store = Store(spark, "lm")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks, n_buckets = max(1, -(-size // block_bytes)), max(1, -(-size // bucket_bytes))
    good = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("good_")).distinct()
    good = F.broadcast(good) if good.count() <= BROADCAST_IDS else good.hint("merge")
    block = F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).cast("int").alias("block")
    # as many tasks as the cluster has room for, not as there are blocks: a shuffle's pieces would grow with the square of the input
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    at_blocks, at_buckets = min(n_blocks, tasks), min(n_buckets, tasks)
    # rows are in the order of their block, so that a task works on one after another
    placed = docs.join(good, F.col("id") == F.col("good_"), "left").select(block, F.col("good_").isNotNull().alias("good"), "id", "text").repartition(at_blocks, "block").sortWithinPartitions("block")

    asked = placed.mapInArrow(_asking(n_buckets), ASKED).repartition(at_buckets, "bucket").sortWithinPartitions("bucket")
    answers = store.keep(asked.mapInArrow(_answering, ANSWER), "answers")
    vocabulary = answers.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0] + 1
    store.settle()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _groups(batches, "block"):
            answered, rows = [], []
            for p in parts:
                text = p["is_text"].to_numpy(zero_copy_only=False).astype(bool)
                at = int(np.argmax(text)) if text.any() else p.num_rows
                answered.append(p.slice(0, at))
                if at < p.num_rows:
                    rows.append(p.slice(at))
            if not rows:
                continue
            keys = Keys([p["text"] for p in rows])
            counts = Counts(keys.counted(_flags(rows)), n_buckets, answered)
            sums, some = np.zeros((2, len(keys.sizes))), np.flatnonzero(keys.sizes)
            if len(some):
                begin = np.cumsum(keys.sizes) - keys.sizes
                sums[:, some] = np.add.reduceat(counts.losses(keys, vocabulary), begin[some], axis=1)
            mean, none = sums / np.maximum(keys.sizes, 1), keys.sizes == 0
            ids = pa.concat_arrays([p["id"] for p in rows])
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys.sizes), *(pa.array(x, mask=none) for x in (mean[0], mean[1], mean[0] - mean[1]))], names=["id", "n_tokens", "target_loss", "background_loss", "difference"])

    packed = [f.name for f in answers.schema.fields if f.name not in ("block", "words")]
    replies = answers.select("block", F.lit(False).alias("is_text"), *packed, *[F.lit(None).cast(t).alias(c) for c, t in (("good", "boolean"), ("id", "long"), ("text", "string"))])
    asking = placed.select("block", F.lit(True).alias("is_text"), *[F.lit(None).cast(answers.schema[c].dataType).alias(c) for c in packed], "good", "id", "text")
    both = replies.unionByName(asking).repartition(at_blocks, "block").sortWithinPartitions("block", "is_text")
    return both.mapInArrow(task, "id long, n_tokens long, target_loss double, background_loss double, difference double").withColumnRenamed("id", id_col)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and difference of every document, rounded to six places."""
    scores = cross_entropy_difference(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "difference")])
