"""Choosing the paragraphs of a document that fit a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scorewright.operators.scan import Blocks, added, carried


def carried_forward(df: DataFrame, doc: str, order: str, value: Column, name: str, default: str = "Unknown") -> DataFrame:
    """The nearest value at or before each row of its document; a document of any length is worked on in blocks."""
    b = Blocks(df.withColumn("own_", value), [doc], [order])
    rows = b.with_before(carry_=carried(F.max_by("own_", F.when(F.col("own_").isNotNull(), F.col("nth_")))))
    nearest = F.last("own_", ignorenulls=True).over(b.inside.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("near_", nearest).select(*[c for c in df.columns if c != name], F.coalesce("near_", "carry_", F.lit(default)).alias(name))


def with_neighbors(df: DataFrame, doc: str, order: str, hits: Column, *, base: int = 100, near: int = 30) -> DataFrame:
    """selection: base + hits for a paragraph with hits, `near` for those beside one, else null.

    Beside a block's first and last row stand the last of the block before and the first of the one after.
    """
    b = Blocks(df.withColumn("hits_", F.coalesce(hits, F.lit(0))), [doc], [order])
    edges = b.rows.groupBy(F.col(doc).alias("d_"), F.col("block_").alias("b_")).agg(F.min_by("hits_", "nth_").alias("first_"), F.max_by("hits_", "nth_").alias("last_"))
    along = Window.partitionBy("d_").orderBy("b_")
    edges = edges.select("d_", "b_", F.lag("last_").over(along).alias("prior_"), F.lead("first_").over(along).alias("later_"))
    own = b.rows.join(edges, F.col(doc).eqNullSafe(F.col("d_")) & (F.col("block_") == F.col("b_")))
    side = lambda f, other: F.coalesce(f("hits_").over(b.inside), F.col(other), F.lit(0)) > 0
    beside = own.withColumn("beside_", side(F.lag, "prior_") | side(F.lead, "later_"))
    return beside.select(*df.columns, F.when(F.col("hits_") > 0, base + F.col("hits_")).when(F.col("beside_"), near).cast("int").alias("selection"))


def budget_prefix(df: DataFrame, doc: str, order: str, tokens: str, chars: str, budget: int, *, header_tokens: int = 0, header_chars: int = 0) -> DataFrame:
    """Rows of each document, in order, while the estimate of all so far fits the budget; the first always stays.

    The estimate of joined paragraphs is the greater of the summed tokens and a quarter of
    the summed characters, so running sums decide: those of a block on top of the sums
    of the blocks before.
    """
    b = Blocks(df, [doc], [order])
    rows = b.with_before(tokens_=added(F.sum(tokens)), chars_=added(F.sum(chars)), rows_=added(F.count("*")))
    upto = b.inside.rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c, earlier: F.sum(c).over(upto) + F.coalesce(earlier, F.lit(0))
    estimate = F.greatest(total(tokens, "tokens_") + header_tokens, F.ceil((total(chars, "chars_") + header_chars) / 4)).cast("long")
    first = F.col("rows_").isNull() & (F.col("nth_") == F.col("first_"))
    return rows.withColumn("running_estimate", estimate).where((F.col("running_estimate") <= budget) | first).select(*df.columns, "running_estimate")


def top_per_category(df: DataFrame, doc: str, order: str, categories: dict[str, Column], *, n: int = 2) -> DataFrame:
    """doc, category, order, score: the n paragraphs of each category with the most keywords, earlier ones first at a tie; those without any are left out."""
    rows = F.filter(F.array(*[F.struct(F.lit(k).alias("category"), c.alias("score")) for k, c in categories.items()]), lambda r: r["score"] > 0)
    long = df.select(doc, order, F.explode(rows).alias("r_")).select(doc, order, "r_.*")
    w = Window.partitionBy(doc, "category").orderBy(F.desc("score"), order)
    return long.withColumn("nth_", F.row_number().over(w)).where(F.col("nth_") <= n).drop("nth_")


def structure(df: DataFrame, doc: str, text: Column) -> DataFrame:
    """Paragraph statistics of each document: count, mean sentence length, least, most and mean length, share of repeated paragraphs."""
    n = F.length(text)
    stops = F.greatest(F.lit(1), F.regexp_count(text, F.lit("[.!?]")))
    norm = F.substring(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 1, 180)
    return df.groupBy(doc).agg(F.count("*").alias("paragraph_count"), F.round(F.avg(n / stops), 3).alias("mean_sentence_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.round(F.avg(n), 3).alias("mean_chars"), F.round(1 - F.count_distinct(norm) / F.count("*"), 6).alias("repetition_ratio"))


def budget_report(prompt_tokens: Column, *, context: int = 4096, predict: int = 192, margin: int = 128) -> Column:
    """Room left in a model's context after prompt, answer and margin, and whether the prompt fits."""
    room = F.lit(context - predict - margin) - prompt_tokens
    return F.struct(room.alias("tokens_left"), (room >= 0).alias("budget_passed"), F.round(prompt_tokens / F.lit(float(context)), 6).alias("context_used"))
