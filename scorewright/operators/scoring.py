"""From dimension ratings to document totals and grades."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scorewright.functions.numbers import grade, standardized, weighted

#: Dimensions and weights of the two kinds of documents.
MDA_WEIGHTS = {"AR01": 0.15, "AR02": 0.25, "AR03": 0.30, "AR04": 0.20, "AR05": 0.10}
NEWS_WEIGHTS = {"N01": 0.25, "N02": 0.25, "N03": 0.20, "N04": 0.20, "N05": 0.10}


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by `order`: the rest are duplicates."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")


def first_values(df: DataFrame, keys: list[str], order: str, *values: str) -> DataFrame:
    """first_rows() for few columns, as an aggregate that combines before the shuffle."""
    return df.groupBy(*keys).agg(*[F.min_by(v, order).alias(v) for v in values])


def pivoted(ratings: DataFrame, codes: list[str], *, id_col: str = "document_id", code_col: str = "dimension_code", score_col: str = "raw_score") -> DataFrame:
    """One row per document with a column for each dimension; null where it has no rating."""
    return ratings.groupBy(id_col).pivot(code_col, codes).agg(F.max(score_col))


def first_pivoted(df: DataFrame, codes: list[str], order: str, *, id_col: str = "document_id", code_col: str = "dimension_code", score_col: str = "raw_score") -> DataFrame:
    """pivoted() of first_values(), in one aggregate by document: a row and one shuffle for each document instead of each of its dimensions."""
    of = lambda c, x: F.when(F.col(code_col) == c, F.col(x))
    return df.groupBy(id_col).agg(*[F.min_by(of(c, score_col), of(c, order)).alias(c) for c in codes])


def unpivoted(wide: DataFrame, codes: list[str], *, ids: list[str], code_col: str = "dimension_code", score_col: str = "raw_score") -> DataFrame:
    return wide.unpivot([F.col(c) for c in ids], [F.col(c) for c in codes], code_col, score_col).where(F.col(score_col).isNotNull())


def complete(wide: DataFrame, codes: list[str]) -> DataFrame:
    """Documents with a valid rating in every dimension."""
    return wide.where(F.forall(F.array(*codes), lambda x: x.isNotNull() & x.between(1, 5)))


def missing_dimensions(ratings: DataFrame, codes: list[str], *, id_col: str = "document_id", code_col: str = "dimension_code") -> DataFrame:
    """(document, code) for each expected dimension without a rating, from one aggregate instead of an anti-join."""
    have = ratings.groupBy(id_col).agg(F.collect_set(code_col).alias("have_"))
    return have.select(id_col, F.explode(F.array_except(F.array(*[F.lit(c) for c in codes]), "have_")).alias(code_col))


def total_of(weights: Mapping[str, float]) -> Column:
    """Sum of rounded weighted standardized scores, rounded."""
    parts = [weighted(standardized(F.col(c)), w) for c, w in weights.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return F.round(out, 6)


def total_once(weights: Mapping[str, float]) -> Column:
    """Like total_of(), rounded once at the end."""
    out = None
    for c, w in weights.items():
        part = 100.0 * (F.col(c) - 1) / 4.0 * F.lit(float(w))
        out = part if out is None else out + part
    return F.round(out, 6)


def document_scores(wide: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Adds total_score_100 and grade_label to complete documents."""
    total = wide.withColumn("total_score_100", total_of(weights))
    return total.withColumn("grade_label", grade(F.col("total_score_100")))


def grade_distribution(scores: DataFrame, groups: list[str] | None = None, *, total_col: str = "total_score_100") -> DataFrame:
    """Counts of every grade, zero where none has it. Grades are recomputed from the totals."""
    groups = groups or []
    counts = scores.groupBy(*groups).agg(*[F.count_if(grade(F.col(total_col)) == g).alias(g) for g in "ABCD"])
    return counts.unpivot([F.col(g) for g in groups], [F.col(g) for g in "ABCD"], "grade_label", "n")


def review_reasons(wide: DataFrame, codes: list[str], *, low_total: float = 55.0) -> DataFrame:
    """One row per document, dimension and broken rule: a score of 1 or 5, a missing rating, a low total (no dimension)."""
    rules = []
    for c in codes:
        rules += [F.struct(F.lit(c).alias("dimension_code"), F.when(F.col(c).isNull(), "missing_rating").when(F.col(c) == 1, "extreme_low_score").when(F.col(c) == 5, "extreme_high_score").alias("reason"))]
    rules.append(F.struct(F.lit("").alias("dimension_code"), F.when(F.col("total_score_100") < low_total, "low_total_score").alias("reason")))
    found = F.filter(F.array(*rules), lambda r: r["reason"].isNotNull())
    return wide.select("document_id", F.explode(found).alias("r")).select("document_id", "r.*")


def overridden(base: DataFrame, replacement: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `base`, replaced whole where `replacement` has the key; rows only there are not added."""
    rest = [c for c in base.columns if c not in keys]
    new = replacement.select(*keys, F.struct(*rest).alias("new_"))
    return base.select(*keys, F.struct(*rest).alias("old_")).join(new, keys, "left").select(*keys, F.coalesce("new_", "old_").alias("r_")).select(*keys, "r_.*")


def prefer_complete(sources: list[DataFrame], codes: list[str], *, id_col: str = "document_id") -> DataFrame:
    """Per document, the rows of the first source that has all dimensions; documents complete in none are left out."""
    tagged = None
    for i, s in enumerate(sources):
        part = s.select(id_col, "dimension_code", "raw_score").withColumn("source_", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    wide = tagged.groupBy(id_col, "source_").pivot("dimension_code", codes).agg(F.max("raw_score"))
    best = complete(wide, codes).groupBy(id_col).agg(F.min_by(F.struct(*codes), "source_").alias("r_"), F.min("source_").alias("source_rank"))
    return best.select(id_col, "source_rank", "r_.*")


def upserted(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last writer wins by key: of all rows, the one with the greatest `order`; changes beat current rows at a tie."""
    rest = [c for c in current.columns if c not in keys]
    both = current.withColumn("layer_", F.lit(0)).unionByName(changes.withColumn("layer_", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("layer_", order)).alias("r_")).select(*keys, "r_.*")


def replaced_partition(current: DataFrame, new: DataFrame, column: str, value: str) -> DataFrame:
    """Rows of one kind dropped, the new ones of that kind put in their place."""
    return current.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(new.where(F.col(column) == value))
