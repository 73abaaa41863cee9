"""Claims: what is passed over, how often a sentence is read, and what counting them needs."""

import random

from pyspark.sql import functions as F

from scorewright.functions import text as X
from scorewright.operators import claims as C
from scorewright.plans import texts


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_white_space_is_that_of_the_plain_pattern(spark):
    rng = random.Random(3)
    signs = "aZ9é!~;, \t\n\r\x0b\x1c\x1f\x85\xa0  ​   　﻿"
    rows = [("".join(rng.choice(signs + " " * 12 + ";,") for _ in range(rng.randrange(14))),) for _ in range(3000)] + [(None,), (" ",), ("  ",), (" ; a , ;",)]
    wide = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{001C}-\x{001F}]+"
    c = F.col("t")
    plain = F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("﻿"), F.lit(" ")), wide, " "))
    got = spark.createDataFrame(rows, "t string").where(~X.one_spaced(c).eqNullSafe(plain) | ~X.stripped_claim(c).eqNullSafe(F.regexp_replace(plain, "^[ ;,]+|[ ;,]+$", "")))
    assert got.collect() == []


def test_no_claim_is_in_a_sentence_that_is_passed_over(spark):
    rng = random.Random(4)
    words = [*C.MDA_WORDS, *C.UP_WORDS, *C.DOWN_WORDS, "la casa", "CAS", "ALS ", "7", "RİSK", "risK", "and", ","]
    rows = [(" ".join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randrange(1, 4))),) for _ in range(800)]
    low, s = F.col("low"), F.col("s")
    df = spark.createDataFrame(rows, "s string").withColumn("low", F.lower("s"))
    ruled = C._mda_rules(s, low, C.direction(low), C.topic(low), C.metric(low))
    assert df.where(~X.contains_any(low, C.MDA_WORDS) & (F.size(ruled) > 0)).collect() == []
    assert df.where(F.size(ruled) > 0).count() > 400


def test_counting_claims_neither_numbers_nor_carries_them(spark, tmp_path):
    rows = [(i, "Revenue rose 5%. The group expects a cautious outlook. Nada mas.") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = texts.claim_type_counts(spark, str(tmp_path))
    assert "collect_list" not in plan(got)
    assert {(r["claim_type"], r["direction"]): r["n"] for r in got.collect()} == {("financial_claim", "neutral"): 20, ("outlook_claim", "decrease"): 20}
    # one file of one group is dealt out to all cores before it is read for claims
    assert C.found(texts.spread(texts.reports(spark, str(tmp_path))), "mda").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
