"""I-Match fingerprints, with DataFrame functions only.

Terms are runs of letters and digits of the lower-cased text. The lexicon holds the
terms whose document frequency lies in a band: at least LEAST of the documents (and
two of them), at most MOST. A text keeps its distinct terms in the lexicon, or all of
its terms if none is in it, sorted by their MD5. The fingerprint is a hash of the kept
terms and one of those in each random subset of the lexicon that the text has terms
in. The lexicon is drawn from at random twice: by one part of the MD5 of its terms into
256 fine subsets, and, independently of that, by another part into 16 coarse ones, so that
every coarse subset shares terms with every fine one. The fine ones tell long texts
apart, the coarse ones short texts. The likeness of two fingerprints is the mean,
over the two kinds, of the share of subsets with equal hashes among those that either
text has terms in.

As every lexicon term is in LEAST of the documents, the lexicon has at most (mean
number of distinct terms of a text) / LEAST entries, whatever the corpus; that bound
is what allows it to be sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from scorewright.llm.common import Store, documents

LEAST = 0.001
MOST = 0.2
#: Hexadecimal digits of a term's MD5 that it is known by in each draw, those of them that name its fine or its coarse subset, and digits of a subset's hash.
DIGITS, FINE, COARSE, HASH = 8, 2, 1, 4
#: Places of the table that the lexicon is looked up in.
SLOTS = 1 << 14
#: Rows of neighbouring ids that are put in order together.
RUN = 2000
SEGMENTS = 64
#: Runs whose order is found in one task, and runs that one task puts in order at most, on average.
RUN_BLOCK, RUNS_A_TASK = 4096, 32
#: Runs whose first ids may be sent to all tasks (about 16 MB); more are joined by a shuffle.
BROADCAST_RUNS = 1_000_000


def terms(text: Column) -> Column:
    """Distinct terms of a text; none for null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def _slot(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


def lexicon(docs: DataFrame, text_col: str = "text", least: float = LEAST, most: float = MOST) -> DataFrame:
    """Terms (term, df) whose document frequency lies in the band."""
    n = docs.count()
    df = docs.select(F.explode(terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.where((F.col("df") >= max(2.0, least * n)) & (F.col("df") <= most * n))


def lookup(lex: DataFrame) -> DataFrame:
    """The lexicon as one row: an array with the terms of each slot."""
    slots = lex.groupBy(_slot(F.col("term")).alias("slot")).agg(F.sort_array(F.collect_list("term")).alias("terms"))
    every = lex.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(slots, "slot", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("terms", F.array().cast("array<string>")).alias("terms")))), lambda s: s["terms"]).alias("table"))


def with_hashes(df: DataFrame, text: Column, lex_col: str, name: str) -> DataFrame:
    """Add `name`, the fingerprint's parts: struct<whole, fine, coarse>.

    Kept terms become fixed-width digests in order, joined by blanks. Digests of one
    subset are neighbours, so taking out the blanks between equal beginnings leaves one
    string for each subset, of its sorted distinct terms. Each step is a column of its
    own: shared parts are computed once.
    """
    table = F.col(lex_col)
    df = df.withColumn("terms_", terms(text))
    df = df.withColumn("in_", F.filter("terms_", lambda t: F.array_contains(table[_slot(t)], t)))
    df = df.withColumn("kept_", F.when(F.size("in_") > 0, F.col("in_")).otherwise(F.col("terms_")))
    df = df.withColumn("digests_", F.transform("kept_", lambda t: F.substring(F.md5(t), 1, 2 * DIGITS)))
    drawn = lambda place: F.array_join(F.sort_array(F.transform("digests_", lambda d: F.substring(d, place, DIGITS))), " ")
    df = df.withColumn("first_", drawn(1)).withColumn("second_", drawn(1 + DIGITS))
    whole = F.substring(F.md5("first_"), 1, 16)
    out = df.withColumn(name, F.struct(whole.alias("whole"), _subsets("first_", FINE).alias("fine"), _subsets("second_", COARSE).alias("coarse")))
    return out.drop("terms_", "in_", "kept_", "digests_", "first_", "second_")


def _subsets(joined: str, digits: int) -> Column:
    """The name and a short hash of each subset that the joined digests of a draw have terms in."""
    runs = F.split(F.regexp_replace(joined, rf" (?<=([0-9a-f]{{{digits}}})[0-9a-f]{{{DIGITS - digits}}} )(?=\1)", ""), " ")
    return F.transform(F.filter(runs, lambda r: r != ""), lambda r: F.concat(F.substring(r, 1, digits), F.substring(F.md5(r), 1, HASH)))


def fingerprint(h: Column) -> Column:
    return F.concat(h["whole"], F.lit("."), F.array_join(h["fine"], ""), F.lit("."), F.array_join(h["coarse"], ""))


def likeness(a: Column, b: Column) -> Column:
    """Mean share of equal subset hashes; without any subset, whether the kept terms are equal."""

    def share(kind: str, digits: int) -> Column:
        names = lambda h: F.transform(h[kind], lambda x: F.substring(x, 1, digits))
        either = F.size(a[kind]) + F.size(b[kind]) - F.size(F.array_intersect(names(a), names(b)))
        return F.try_divide(F.size(F.array_intersect(a[kind], b[kind])).cast("double"), either.cast("double"))

    fine, coarse = share("fine", FINE), share("coarse", COARSE)
    return F.coalesce((fine + coarse) / 2, (a["whole"] == b["whole"]).cast("double"))


def with_next(docs: DataFrame, id_col: str, order: list[str], more: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """Add next_<column> of the row that follows by id (then `order`); after the last comes the first.

    `more` adds columns once rows have been dealt out, so that they are not shuffled.

    Rows are cut into runs of neighbouring ids at quantiles of the id, and evenly
    between them. Each run is ordered by itself and gets, as its end, the first rows
    of the next run. Null ids come first.
    """
    n = docs.count()
    bounds = sorted({int(b) for b in docs.where(F.col(id_col).isNotNull()).approxQuantile(id_col, [i / SEGMENTS for i in range(1, SEGMENTS)], 0.002)}) if n else []
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    edges = [low if low is not None else 0, *[b for b in bounds if low < b <= high], (high if high is not None else 0) + 1]
    inner = max(1, n // (RUN * max(1, len(edges) - 1)))
    arr = F.array(*[F.lit(e).cast("long") for e in edges])
    i = F.col(id_col).cast("long")
    seg = F.size(F.filter(arr, lambda e: e <= i))  # 1-based
    start, stop = arr[seg - 1], arr[seg]
    run = F.when(i.isNull(), F.lit(-1).cast("long")).otherwise(seg.cast("long") * inner + F.least(F.floor((i - start) * F.lit(inner) / (stop - start)), F.lit(inner - 1)))
    placed = docs.withColumn("run_", run)
    firsts = placed.groupBy("run_").agg(F.min(id_col).alias("first_")).withColumn("block_", F.floor(F.col("run_") / RUN_BLOCK))
    # runs are ordered within their block, and blocks (a row for millions of documents) by themselves
    blocks = firsts.groupBy("block_").agg(F.max("run_").alias("tail_"))
    blocks = blocks.select("block_", F.coalesce(F.lag("tail_").over(Window.orderBy("block_")), F.max("tail_").over(Window.partitionBy())).alias("earlier_"))
    in_block = Window.partitionBy("block_").orderBy("run_")
    ends = firsts.join(blocks, "block_").select("first_", F.coalesce(F.lag("run_").over(in_block), F.col("earlier_")).alias("run_"))
    if n // RUN <= BROADCAST_RUNS:
        ends = F.broadcast(ends)
    tail = docs.join(ends, docs[id_col].eqNullSafe(ends["first_"])).drop("first_").withColumn("end_", F.lit(1))
    whole = placed.withColumn("end_", F.lit(0)).unionByName(tail)
    w = Window.partitionBy("run_").orderBy("end_", F.col(id_col).asc_nulls_first(), *order)
    tasks = n // (RUN * RUNS_A_TASK)
    more_tasks = [tasks] if tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    ahead = more(whole.repartition(*more_tasks, "run_")).select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return ahead.where("end_ = 0").drop("run_", "end_")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, most: float = MOST) -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness.

    One row per input row: id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. The edited text has the text's last
    floor(n_chars / 2) characters replaced by the first as many (or all) of the next
    document by id; rows with one id follow each other by text. Null counts as the
    empty text, whose fingerprint is that of no terms. Other columns are not read.
    """
    spark = docs.sparkSession
    store = Store(spark, "imatch")
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = store.keep(lookup(store.keep(lexicon(docs, "text", least, most), "lexicon")), "lookup")
    own = lambda df: with_hashes(df.withColumn("lex_", table.scalar()), F.col("text"), "lex_", "own").drop("lex_")
    near = with_next(docs, "id", ["text"], own, ["text", "own"]).withColumnRenamed("next_own", "next")
    half = F.expr("cast(floor(char_length(text) / 2) as int)")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next_text", F.lit(1), half))
    near = with_hashes(near.withColumn("edited", edited).withColumn("lex_", table.scalar()), F.col("edited"), "lex_", "changed")
    return near.select(F.col("id").alias(id_col), F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))


def op4_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    return fingerprints(documents(spark, sf_dir))
