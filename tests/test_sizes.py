"""Work that grows with its input and no faster: what an operator does a row, and what it gathers."""

import time

from pyspark.sql import functions as F

from scorewright.operators import documents, numeric


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_statement_is_read_once_for_all_its_parts(spark):
    docs = spark.createDataFrame([("a", "Net profit rose by 5% from RM10 million to RM12 million.")], "document_id string, text string")
    found = numeric.stated_changes(docs.select(F.col("document_id").alias("id"), numeric.prepared(F.col("text")).alias("flat"), numeric.marked(F.col("text")).alias("parts")))
    assert "regexp_extract(" not in plan(found)
    # each form is looked for once and taken apart once
    assert plan(found).count("regexp_extract_all(") <= 6
    assert [r["check"]["calculated"] for r in found.collect()] == [20.0]


def test_amounts_of_a_long_paragraph_take_time_in_proportion(spark):
    words = " ".join(f"RM{i} million profit" for i in range(3000))
    docs = spark.createDataFrame([("a", f"Segment {words} total 7 margin 5% revenue 3.")], "document_id string, text string")
    began = time.time()
    assert {r["metric"] for r in numeric.numeric_checks(docs).collect()} == {"margin", "segment revenue"}
    assert time.time() - began < 60


def test_places_are_those_of_the_text(spark):
    text = "x 1.5 million, -2% and RM 3,000 sen"
    got = spark.range(1).select(numeric.placed(F.lit(text), r"\d[\d,.]*").alias("p")).first()["p"]
    assert [(p["match"], text[p["start"] : p["stop"]]) for p in got] == [("1.5", "1.5"), ("2", "2"), ("3,000", "3,000")]


def test_a_large_book_keeps_its_first_checks_before_the_shuffle(spark):
    checks = spark.range(5000).select(F.format_string("b%s", F.col("id") % 1).alias("book"), F.format_string("%05d", "id").alias("evidence_locator"), F.when(F.col("id") % 3 == 0, "consistent").otherwise("material_discrepancy").alias("status"), F.lit("").alias("source_text"))
    got = documents.compact_by_group(checks, "book", ["evidence_locator"], 4)
    assert "WindowGroupLimit" in plan(got)
    assert [r["c"]["evidence_locator"] for r in got.collect()] == ["00001", "00002", "00004", "00005"]


def test_articles_are_those_of_the_expression_and_cut_once(spark):
    rows = [("a", "One.\n\nTwo."), ("b", "Aaa. Bbb. Ccc."), ("c", None), ("d", " \n\n Only one part. ")]
    df = spark.createDataFrame(rows, "title string, text string")
    got = documents.articles(df, "title", "text", 6)
    want = df.select("title", documents.article_paragraphs(F.col("title"), F.col("text"), 6).alias("article"))
    assert got.select("title", "article").collect() == want.collect()
    assert plan(got).count("split(") < plan(want).count("split(")
