"""Adapters that give the driver's tables the shape of ratings, runs and registries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.operators.scoring import complete, document_scores, first_pivoted, first_values, total_of

CODES = ["D1", "D2", "D3", "D4", "D5"]
WEIGHTS = dict(zip(CODES, (0.15, 0.25, 0.30, 0.20, 0.10), strict=True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_ratings(spark: SparkSession, sf_dir: str, *, dealt: bool = False) -> DataFrame:
    """Ratings with repeats: each order line rates one dimension of its order. If `dealt`, those of a document are in one task."""
    li = table(spark, sf_dir, "lineitem")
    li = li.select("l_orderkey", "l_linenumber").repartition("l_orderkey") if dealt else li
    return li.select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("D"), (1 + (F.col("l_linenumber") - 1) % 5).cast("string")).alias("dimension_code"), (1 + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3) % 5).cast("int").alias("raw_score"), F.col("l_linenumber").alias("row_ord"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rating of each (document, dimension)."""
    return first_values(raw_ratings(spark, sf_dir), ["document_id", "dimension_code"], "row_ord", "raw_score")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    # lines are smaller than what an aggregate keeps of a document, which a task that reads a large part of a file would hold for all of its documents
    return first_pivoted(raw_ratings(spark, sf_dir, dealt=True), CODES, "row_ord")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete documents with totals and grades."""
    return document_scores(complete(wide(spark, sf_dir), CODES), WEIGHTS)


def scored_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scores() with company, year and market segment."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("company_id"), F.year("o_orderdate").alias("report_year"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("segment"))
    return scores(spark, sf_dir).join(o, "document_id").join(c, "company_id", "left")


SQL_RATINGS = """ratings AS (SELECT l_orderkey AS document_id, 'D' || (1 + (l_linenumber - 1) % 5) AS dimension_code,
  (1 + (l_orderkey * 7 + min(l_linenumber) * 3) % 5)::INTEGER AS raw_score FROM lineitem GROUP BY l_orderkey, (l_linenumber - 1) % 5)"""
SQL_WIDE = SQL_RATINGS + """,
wide AS (SELECT document_id, """ + ", ".join(f"max(CASE WHEN dimension_code = '{c}' THEN raw_score END) AS {c}" for c in CODES) + """ FROM ratings GROUP BY document_id),
complete AS (SELECT * FROM wide WHERE D1 + D2 + D3 + D4 + D5 IS NOT NULL)"""


def sql_total(weights=WEIGHTS) -> str:
    return "round(" + " + ".join(f"round(round(100.0::DOUBLE * ({c} - 1) / 4.0::DOUBLE, 6) * {w}::DOUBLE, 6)" for c, w in weights.items()) + ", 6)"


def sql_grade(x: str) -> str:
    return f"CASE WHEN {x} >= 85 THEN 'A' WHEN {x} >= 70 THEN 'B' WHEN {x} >= 55 THEN 'C' ELSE 'D' END"


SQL_SCORES = SQL_WIDE + f""",
scores AS (SELECT *, {sql_grade('total_score_100')} AS grade_label FROM (SELECT *, {sql_total()} AS total_score_100 FROM complete))"""
SQL_COMPANIES = SQL_SCORES + """,
companies AS (SELECT s.*, o_custkey AS company_id, year(o_orderdate)::INTEGER AS report_year, c_name AS company_name, c_mktsegment AS segment
  FROM scores s JOIN orders ON o_orderkey = document_id LEFT JOIN customer ON c_custkey = o_custkey)"""
