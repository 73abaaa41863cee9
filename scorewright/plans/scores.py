"""Queries on ratings, totals, grades and company-year aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from scorewright.functions.numbers import difference_flag, grade
from scorewright.operators import scoring as S
from scorewright.operators import stats as T
from scorewright.plans import ratings as R
from scorewright.plans.ratings import CODES, SQL_COMPANIES, SQL_RATINGS, SQL_SCORES, SQL_WIDE, WEIGHTS

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SUMMARY_SQL = "count({x}) AS n, round(avg({x}), 6) AS mean, round(quantile_cont({x}::DOUBLE, 0.5), 6) AS median, round(stddev_pop({x}), 6) AS pstdev, min({x})::DOUBLE AS min, max({x})::DOUBLE AS max, round(quantile_cont({x}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({x}::DOUBLE, 0.75), 6) AS p75"


@query(f"WITH {SQL_COMPANIES} SELECT document_id, company_id, company_name, report_year, total_score_100, grade_label FROM companies")
def doc_scores_total_grade(spark, sf_dir):
    return R.scored_companies(spark, sf_dir).select("document_id", "company_id", "company_name", "report_year", "total_score_100", "grade_label")


@query(f"WITH {SQL_WIDE} SELECT * FROM wide")
def doc_scores_pivot(spark, sf_dir):
    return R.wide(spark, sf_dir)


@query(f"WITH {SQL_WIDE} " + " UNION ALL ".join(f"SELECT document_id, '{c}' AS dimension_code, {c} AS raw_score, 25.0::DOUBLE * ({c} - 1) AS std_score_100 FROM complete" for c in CODES))
def ratings_unpivot(spark, sf_dir):
    return S.unpivoted(S.complete(R.wide(spark, sf_dir), CODES), CODES, ids=["document_id"]).withColumn("std_score_100", F.round(100.0 * (F.col("raw_score") - 1) / 4.0, 6))


@query(f"WITH {SQL_RATINGS} SELECT d.document_id, c.code AS dimension_code FROM (SELECT DISTINCT document_id FROM ratings) d CROSS JOIN (VALUES ('D1'), ('D2'), ('D3'), ('D4'), ('D5')) c(code) WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.document_id = d.document_id AND r.dimension_code = c.code)")
def incomplete_documents(spark, sf_dir):
    return S.missing_dimensions(R.ratings(spark, sf_dir), CODES)


@query(
    f"WITH {SQL_SCORES}, t AS (SELECT w.*, s.total_score_100 FROM wide w LEFT JOIN scores s USING (document_id)) "
    + " UNION ALL ".join(f"SELECT document_id, '{c}' AS dimension_code, CASE WHEN {c} IS NULL THEN 'missing_rating' WHEN {c} = 1 THEN 'extreme_low_score' ELSE 'extreme_high_score' END AS reason FROM t WHERE {c} IS NULL OR {c} IN (1, 5)" for c in CODES)
    + " UNION ALL SELECT document_id, '', 'low_total_score' FROM t WHERE total_score_100 < 55"
)
def review_reasons(spark, sf_dir):
    wide = R.wide(spark, sf_dir)
    return S.review_reasons(wide.withColumn("total_score_100", S.total_of(WEIGHTS)), CODES)


@query(f"WITH {SQL_COMPANIES}, g AS (SELECT unnest(['A', 'B', 'C', 'D']) AS grade_label), s AS (SELECT DISTINCT segment FROM companies) SELECT s.segment, g.grade_label, count(c.document_id) AS n FROM s CROSS JOIN g LEFT JOIN companies c ON c.segment = s.segment AND c.grade_label = g.grade_label GROUP BY 1, 2")
def grade_distribution_zero_filled(spark, sf_dir):
    return S.grade_distribution(R.scored_companies(spark, sf_dir), ["segment"])


@query(f"WITH {SQL_COMPANIES} SELECT segment, {_SUMMARY_SQL.format(x='total_score_100')} FROM companies GROUP BY segment")
def score_summary_by_segment(spark, sf_dir):
    return T.summary(R.scored_companies(spark, sf_dir), "total_score_100", ["segment"])


@query(f"WITH {SQL_RATINGS} SELECT dimension_code, {_SUMMARY_SQL.format(x='raw_score')} FROM ratings GROUP BY dimension_code")
def dimension_summary(spark, sf_dir):
    return T.summary(R.ratings(spark, sf_dir), "raw_score", ["dimension_code"])


@query(f"WITH {SQL_COMPANIES}, l AS (SELECT segment, unnest(['D1', 'D2', 'D3', 'D4', 'D5']) AS dimension_code, unnest([D1, D2, D3, D4, D5]) AS raw_score FROM companies) SELECT segment, dimension_code, count(*) AS n, round(stddev_pop(raw_score), 6) AS pstdev FROM l GROUP BY 1, 2 HAVING count(*) >= 2 AND stddev_pop(raw_score) < 1.35")
def low_variance_dimensions(spark, sf_dir):
    long = S.unpivoted(R.scored_companies(spark, sf_dir), CODES, ids=["segment"])
    return long.groupBy("segment", "dimension_code").agg(F.count("*").alias("n"), F.round(F.stddev_pop("raw_score"), 6).alias("pstdev"), F.stddev_pop("raw_score").alias("s")).where("n >= 2 and s < 1.35").drop("s")


@query("""WITH o AS (SELECT o_custkey AS company_id, year(o_orderdate)::INTEGER AS report_year, o_orderkey, o_totalprice AS v, o_orderpriority AS p FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY company_id, report_year ORDER BY v, o_orderkey) AS k, count(*) OVER (PARTITION BY company_id, report_year) AS n FROM o),
t AS (SELECT company_id, report_year, round(avg(v), 6) AS trimmed_mean FROM (SELECT *, CASE WHEN n < 10 THEN 0 ELSE greatest(1, floor(n * 0.1)) END AS c FROM r) WHERE k > c AND k <= n - c GROUP BY 1, 2)
SELECT o.company_id, o.report_year, count(*) AS n_documents, round(avg(v), 6) AS mean_score, round(quantile_cont(v, 0.5), 6) AS median_score, any_value(trimmed_mean) AS trimmed_mean,
  round(avg(CASE WHEN p IN ('1-URGENT', '2-HIGH') THEN v END), 6) AS mean_high_relevance, round(max(v) - min(v), 6) AS score_range,
  CASE WHEN max(v) - min(v) > 200000 THEN 'wide' WHEN max(v) - min(v) > 50000 THEN 'moderate' ELSE 'stable' END AS range_flag, count(*) < 3 AS low_count
FROM o JOIN t USING (company_id, report_year) GROUP BY o.company_id, o.report_year""")
def company_year_aggregation(spark, sf_dir):
    o = R.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.year("o_orderdate").alias("report_year"), "o_orderkey", F.col("o_totalprice").alias("v"), "o_orderpriority")
    keys = ["company_id", "report_year"]
    spread = F.max("v") - F.min("v")
    high = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("v"))
    agg = o.groupBy(*keys).agg(F.count("*").alias("n_documents"), F.round(F.avg("v"), 6).alias("mean_score"), F.round(F.avg(high), 6).alias("mean_high_relevance"), F.round(spread, 6).alias("score_range"), difference_flag(spread, (50000, "moderate"), (200000, "wide")).alias("range_flag"), (F.count("*") < 3).alias("low_count"))
    # the median too is taken from ranges of values: an aggregate would hold all values of a large group
    return agg.join(T.order_statistics(o, "v", keys, shares={"median_score": 0.5}).drop("n"), keys)


@query(None)
def company_year_bootstrap(spark, sf_dir):
    o = R.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.year("o_orderdate").alias("report_year"), "o_orderkey", "o_totalprice")
    return T.bootstrap_interval(o, "o_totalprice", ["company_id", "report_year"], "o_orderkey")


@query(f"""WITH {SQL_COMPANIES}, b AS (SELECT segment, count(*) AS docs FROM companies GROUP BY 1),
l AS (SELECT segment, unnest(['D1', 'D2', 'D3', 'D4', 'D5']) AS dimension_code, unnest([D1, D2, D3, D4, D5]) AS raw_score FROM companies)
SELECT segment, dimension_code, count(*) FILTER (raw_score IN (1, 5)) AS reviews, any_value(docs) AS documents, round(count(*) FILTER (raw_score IN (1, 5))::DOUBLE / any_value(docs), 6) AS review_rate, count(*) FILTER (raw_score IN (1, 5))::DOUBLE / any_value(docs) > 0.40 AS issue FROM l JOIN b USING (segment) GROUP BY 1, 2""")
def review_rate_per_dimension(spark, sf_dir):
    long = S.unpivoted(R.scored_companies(spark, sf_dir), CODES, ids=["segment"])
    reviews, n = F.count_if(F.col("raw_score").isin(1, 5)), F.count("*")
    return long.groupBy("segment", "dimension_code").agg(reviews.alias("reviews"), n.alias("documents"), F.round(reviews / n, 6).alias("review_rate"), (reviews / n > 0.40).alias("issue"))


_SQL_RUNS = """x AS (SELECT *, 1 + (document_id * 11 + 3) % 5 AS redo FROM wide)"""


@query(f"""WITH {SQL_WIDE}, b AS (SELECT document_id, dimension_code, raw_score FROM ratings),
n AS (SELECT document_id, dimension_code, (1 + (raw_score + 1) % 5)::INTEGER AS raw_score FROM ratings WHERE (document_id + raw_score) % 4 = 0)
SELECT b.document_id, b.dimension_code, coalesce(n.raw_score, b.raw_score) AS raw_score, n.raw_score IS NOT NULL AS replaced FROM b LEFT JOIN n USING (document_id, dimension_code)""")
def replacement_override(spark, sf_dir):
    base = R.ratings(spark, sf_dir).withColumn("replaced", F.lit(False))
    new = base.where((F.col("document_id") + F.col("raw_score")) % 4 == 0).withColumn("raw_score", (1 + (F.col("raw_score") + 1) % 5).cast("int")).withColumn("replaced", F.lit(True))
    return S.overridden(base, new, ["document_id", "dimension_code"])


@query(f"""WITH {SQL_RATINGS},
a AS (SELECT document_id, dimension_code, raw_score FROM ratings WHERE document_id % 3 <> 0 OR dimension_code <> 'D5'), b AS (SELECT document_id, dimension_code, (1 + raw_score % 5)::INTEGER AS raw_score FROM ratings),
w AS (SELECT s, document_id, """ + ", ".join(f"max(CASE WHEN dimension_code = '{c}' THEN raw_score END) AS {c}" for c in CODES) + """ FROM (SELECT 0 AS s, * FROM a UNION ALL SELECT 1, * FROM b) GROUP BY 1, 2 HAVING count(DISTINCT dimension_code) = 5)
SELECT document_id, s AS source_rank, D1, D2, D3, D4, D5 FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY s) AS k FROM w) WHERE k = 1""")
def prefer_complete_source(spark, sf_dir):
    r = R.ratings(spark, sf_dir)
    batch = r.where((F.col("document_id") % 3 != 0) | (F.col("dimension_code") != "D5"))
    return S.prefer_complete([batch, r.withColumn("raw_score", (1 + F.col("raw_score") % 5).cast("int"))], CODES)


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, 0 AS layer FROM lineitem WHERE l_linenumber <= 4 UNION ALL SELECT l_orderkey, l_linenumber, l_quantity + 100, l_shipdate, 1 FROM lineitem WHERE l_linenumber IN (2, 5)),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY layer DESC, l_shipdate DESC, l_quantity DESC) AS k FROM u)
SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM r WHERE k = 1""")
def upsert_latest(spark, sf_dir):
    li = R.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate").withColumn("stamp", F.struct("l_shipdate", "l_quantity"))
    changes = li.where(F.col("l_linenumber").isin(2, 5)).withColumn("l_quantity", F.col("l_quantity") + 100).withColumn("stamp", F.struct("l_shipdate", "l_quantity"))
    return S.upserted(li.where("l_linenumber <= 4"), changes, ["l_orderkey", "l_linenumber"], "stamp").drop("stamp")


@query("""SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'rewritten', round(o_totalprice * 2, 2) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000""")
def replaced_review_partition(spark, sf_dir):
    o = R.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    new = o.where("o_totalprice > 100000").withColumn("o_orderpriority", F.lit("rewritten")).withColumn("o_totalprice", F.round(F.col("o_totalprice") * 2, 2))
    return S.replaced_partition(o, new, "o_orderstatus", "F").drop("o_orderstatus")


@query(f"""WITH {SQL_COMPANIES}, r AS (SELECT *, CASE WHEN grade_label = 'D' THEN 'low_score' WHEN grade_label = 'A' THEN 'high_score' WHEN D2 = 5 THEN 'numeric' ELSE 'baseline' END AS sample_reason FROM companies),
f AS (SELECT *, row_number() OVER (PARTITION BY sample_reason, segment ORDER BY total_score_100, document_id) AS k FROM r)
SELECT sample_reason, segment, document_id, total_score_100 FROM f WHERE k <= 2""")
def stratified_sample(spark, sf_dir):
    from scorewright.operators.samples import first_of_strata

    c = R.scored_companies(spark, sf_dir)
    reason = F.when(F.col("grade_label") == "D", "low_score").when(F.col("grade_label") == "A", "high_score").when(F.col("D2") == 5, "numeric").otherwise("baseline")
    return first_of_strata(c.withColumn("sample_reason", reason), ["sample_reason", "segment"], ["total_score_100", "document_id"], per=2).select("sample_reason", "segment", "document_id", "total_score_100")


@query(f"""WITH {SQL_COMPANIES}, r AS (SELECT document_id, CASE WHEN D2 <= 2 THEN 1 WHEN grade_label = 'D' THEN 2 WHEN grade_label = 'A' THEN 3 ELSE 4 END AS reason_rank, total_score_100, D1, D2, D3, D4, D5 FROM companies),
t AS (SELECT * FROM r ORDER BY reason_rank, total_score_100, document_id LIMIT 30)
SELECT document_id, reason_rank, unnest(['D1', 'D2', 'D3', 'D4', 'D5']) AS dimension_code, unnest([D1, D2, D3, D4, D5]) AS raw_score FROM t""")
def document_priority_sample(spark, sf_dir):
    from scorewright.operators.samples import priority_documents

    c = R.scored_companies(spark, sf_dir)
    rank = F.when(F.col("D2") <= 2, 1).when(F.col("grade_label") == "D", 2).when(F.col("grade_label") == "A", 3).otherwise(4)
    top = priority_documents(c.withColumn("reason_rank", rank), ["reason_rank", "total_score_100", "document_id"], 30)
    return S.unpivoted(top, CODES, ids=["document_id", "reason_rank"])
