"""Token totals kept up to date by signed changes.

The store has five kinds of tables under one path: `ledger` (what each document of a
batch counts for since then, by tokenizer version), `state` (what all count for after a
batch: the parts of the ledger up to there in one, so that a batch reads a bounded number
of them), `changes` (signed totals of a batch by source, language and version), `sums` (the
changes up to a batch in one) and `commits` (one row for each batch that is complete). A
batch looks up its own documents in the ledger; the others are not grouped. Batches come in the order of their
numbers, from one writer at a time. A batch writes its ledger and changes first and its
commit last. Readers take only committed batches, so a batch that broke off has no effect
and is written anew when it comes again, and a batch that is committed already is
passed over: committing one twice changes nothing. Totals are sums of changes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm.common import arrow_batches, documents, shared_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's library splits a text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUP = ["source", "lang", "version"]
LEDGER = "doc_id long, version string, source string, lang string, n_tokens long, live boolean, batch long"
CHANGES = "source string, lang string, version string, d_docs long, d_tokens long, batch long"


class Rollup:
    """Rollup store at `path`. Batches are numbered; a later number overrides an earlier one.

    After every `compact_after` parts of the ledger they are written as one state.
    """

    def __init__(self, spark: SparkSession, path: str, compact_after: int = 8):
        self.spark, self.path, self.compact_after = spark, path.rstrip("/"), compact_after

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def committed(self) -> list[int]:
        """Numbers of the batches whose commit is there, ascending."""
        return self._complete("commits")

    def _parts(self, whole: str = "state", single: str = "ledger") -> list[str]:
        """The tables that the ledger (or the changes) are made of: the last state (or sums) and the committed parts after it."""
        done = self.committed()
        base = [b for b in self._complete(whole) if b in done][-1:]
        return [f"{whole}/{b}" for b in base] + [f"{single}/{b}" for b in done if not base or b > base[0]]

    def _complete(self, table: str) -> list[int]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def ledger(self) -> DataFrame:
        """What each (doc_id, version) counts for now."""
        return self._now().select("doc_id", "version", "source", "lang", "n_tokens")

    def _now(self, of: DataFrame | None = None) -> DataFrame:
        """The ledger's latest rows that are live; of the keys (doc_id, version) in `of` alone, if given."""
        rows = self._read(LEDGER, self._parts())
        if of is not None:
            rows = rows.join(of, ["doc_id", "version"], "left_semi")
        return rows.groupBy("doc_id", "version").agg(F.max_by(F.struct("source", "lang", "n_tokens", "live", "batch"), "batch").alias("now")).where("now.live").select("doc_id", "version", "now.*")

    def compact(self) -> None:
        """Write what the ledger says after the last batch as one state, and all changes as one table of sums, which readers then take up."""
        done = self.committed()
        if done and done[-1] not in self._complete("state"):
            self._now().write.mode("overwrite").parquet(f"{self.path}/state/{done[-1]}")
        if done and done[-1] not in self._complete("sums"):
            self._summed().withColumn("batch", F.lit(done[-1]).cast("long")).write.mode("overwrite").parquet(f"{self.path}/sums/{done[-1]}")

    def _summed(self) -> DataFrame:
        return self._read(CHANGES, self._parts("sums", "changes")).groupBy(*GROUP).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens; groups without documents left are not shown."""
        return self._summed().withColumnsRenamed({"d_docs": "n_docs", "d_tokens": "n_tokens"}).where("n_docs <> 0")

    def commit(self, batch: int, events: DataFrame) -> bool:
        """Apply events (doc_id, version, op, source, lang, n_tokens); False if the batch was committed before.

        A batch that was never committed must have a higher number than those that were:
        its changes are told against what they left (ValueError otherwise).
        op is insert, revise or delete. An insert of a document that counts already and
        a revision replace what it counted for (a revision may leave source and lang null:
        they stay); a revision or deletion of one that does not count changes nothing. Of
        several events for one (doc_id, version) in a batch, a deletion wins, else the one
        with the most tokens. Events with a null doc_id, version or op are passed over;
        null n_tokens count as 0.
        """
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        if len(self._parts()) > self.compact_after:
            self.compact()
        clean = events.where("doc_id is not null and version is not null and op in ('insert', 'revise', 'delete')").select(F.col("doc_id").cast("long").alias("doc_id"), "version", "op", "source", "lang", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
        one = clean.groupBy("doc_id", "version").agg(F.max(F.struct((F.col("op") == "delete").alias("gone"), "n_tokens", (F.col("op") == "insert").alias("fresh"), "source", "lang")).alias("e"))
        old = self._now(one.select("doc_id", "version")).select("doc_id", "version", "source", "lang", "n_tokens").withColumnsRenamed({"source": "old_source", "lang": "old_lang", "n_tokens": "old_tokens"})
        both = one.join(old, ["doc_id", "version"], "left").where("old_tokens is not null or (e.fresh and not e.gone)")
        new = both.select("doc_id", "version", F.when(F.col("e.fresh"), F.col("e.source")).otherwise(F.coalesce("e.source", "old_source")).alias("source"), F.when(F.col("e.fresh"), F.col("e.lang")).otherwise(F.coalesce("e.lang", "old_lang")).alias("lang"), F.when(F.col("e.gone"), F.lit(0)).otherwise(F.col("e.n_tokens")).cast("long").alias("n_tokens"), (~F.col("e.gone")).alias("live"), "old_source", "old_lang", "old_tokens")
        ledger = f"{self.path}/ledger/{batch}"
        kept = new.withColumn("batch", F.lit(batch).cast("long"))
        kept.write.mode("overwrite").parquet(ledger)
        done = self.spark.read.schema(kept.schema).parquet(ledger)
        plus = done.where("live").select(*GROUP, F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))
        minus = done.where("old_tokens is not null").select(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), "version", F.lit(-1).cast("long").alias("d_docs"), (-F.col("old_tokens")).alias("d_tokens"))
        plus.unionByName(minus).groupBy(*GROUP).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).where("d_docs <> 0 or d_tokens <> 0").withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.path}/changes/{batch}")
        self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{batch}")
        return True


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def count_tokens(docs: DataFrame, *, text_cols: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """docs without `text_cols`, with n_<column> for each: byte-pair tokens of the text (null: null). A text equal to the column before is counted once."""
    import tiktoken

    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    rest = [f for f in docs.schema.fields if f.name not in text_cols]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"n_{c} long" for c in text_cols])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        for batch in batches:
            out, last, counts = [], None, None
            for c in text_cols:
                texts = batch[c].to_pylist()
                counts = [None if t is None else counts[i] if last is not None and last[i] == t else len(coder.encode_ordinary(t)) for i, t in enumerate(texts)]
                out.append(pa.array(counts, pa.int64()))
                last = texts
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in rest), *out], names=[*(f.name for f in rest), *(f"n_{c}" for c in text_cols)])

    return docs.mapInArrow(task, schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all texts inserted under two tokenizers, texts with runs of white space revised to collapsed ones, later copies of a text deleted, and the first batch sent once more."""
    import uuid

    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "text")
    flat = F.regexp_replace("text", r"[\x20\x09-\x0D]{2,}", " ")
    seen = count_tokens(docs.select("doc_id", "source", "lang", F.sha2("text", 256).alias("body"), F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long").alias("words"), "text", flat.alias("flat")), text_cols=["text", "flat"])
    base = f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}"
    seen.write.parquet(f"{base}/counts")
    seen = spark.read.schema(seen.schema).parquet(f"{base}/counts")

    def events(rows: DataFrame, op: str, tokens: str) -> DataFrame:
        return rows.select("doc_id", F.inline(F.array(F.struct(F.lit("words").alias("version"), F.col("words").alias("n_tokens")), F.struct(F.lit("byte_bpe_50k").alias("version"), F.col(tokens).alias("n_tokens")))), "source", "lang").withColumn("op", F.lit(op))

    first = events(seen, "insert", "n_text")
    revised = events(seen.where("n_flat <> n_text"), "revise", "n_flat").where("version = 'byte_bpe_50k'")
    least = seen.where("body is not null").groupBy("body").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    least.write.parquet(f"{base}/repeated")
    least = spark.read.schema(least.schema).parquet(f"{base}/repeated")
    copies = events(seen.join(least, "body").where("doc_id <> first"), "delete", "n_text")
    rollup = Rollup(spark, base)
    for number, batch in ((1, first), (2, revised), (3, copies), (1, first)):
        rollup.commit(number, batch)
    return rollup.totals()
