"""Crafted cases of single operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scorewright.functions import dates, numbers, text
from scorewright.operators import claims, context, dedupe, fundamentals, gates, jsonfix, numeric, ranking, relevance, scoring, stats
from scorewright.sources.tables import keeper

CODES = ["AR01", "AR02", "AR03", "AR04", "AR05"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scores_and_ranks_of_the_worked_example(spark):
    rows = [("A", 5, 5, 3, 3, 2), ("B", 3, 5, 5, 3, 2), ("C", 2, 3, 4, 3, 2), ("D", 1, 2, 2, 3, 2), ("E", 4, 1, 1, 3, 2)]
    df = spark.createDataFrame(rows, "document_id string, " + ", ".join(f"{c} int" for c in CODES))
    out = ranking.competition_rank(scoring.document_scores(df, scoring.MDA_WEIGHTS), "total_score_100")
    got = {r["document_id"]: (r["total_score_100"], r["rank"]) for r in out.collect()}
    assert got["A"][0] == 67.5
    assert got["B"] == (75.0, 1)
    flat = df.agg(numbers.pearson_of("AR04", "AR05").alias("a"), numbers.pearson_of("AR04", "AR04", constant=numbers.same_everywhere("AR04", "AR04")).alias("b")).first()
    assert (flat["a"], flat["b"]) == (0.0, 1.0)


@pytest.mark.parametrize("score,want", [(85.0, "A"), (84.999999, "B"), (70.0, "B"), (55.0, "C"), (54.9, "D")])
def test_grade_borders(spark, score, want):
    assert one(spark, numbers.grade(F.lit(score))) == want


def test_number_or_never_raises(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("",), ("nan",), (None,)], "v string")
    assert [r[0] for r in df.select(numbers.number_or(F.col("v"), -1.0)).collect()] == [1.5, -1.0, -1.0, -1.0, -1.0]


def test_ranks_against_sorting(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randint(0, 6))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, v double")
    avg = {r["id"]: r["rank"] for r in ranking.average_rank(df, "v").collect()}
    ordinal = {r["id"]: r["rank"] for r in ranking.ordinal_rank(df, "v", [F.col("id")]).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert ordinal == {r[0]: i + 1 for i, r in enumerate(order)}
    for i, v in rows:
        below, same = sum(x < v for _, x in rows), sum(x == v for _, x in rows)
        assert avg[i] == below + (same + 1) / 2


def test_edge_sizes(spark):
    assert one(spark, ranking.edge_size(F.lit(12))) == 3
    assert one(spark, ranking.edge_size(F.lit(12), rounding="even")) == 2
    assert one(spark, ranking.edge_size(F.lit(1))) == 1


def test_kappa_and_icc(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (5, 4), (3, 3)], "x int, y int")
    assert 0.9 < stats.weighted_kappa(df, "x", "y").first()["kappa"] < 1
    same = spark.createDataFrame([(2, 2), (2, 2)], "x int, y int")
    assert stats.weighted_kappa(same, "x", "y").first()["kappa"] == 1.0
    assert stats.icc1(df.limit(1), "x", "y").first()["icc"] == 0.0
    assert stats.icc1(df, "x", "x").first()["icc"] == 1.0


def test_p_values():
    assert stats.student_two_tailed(3.072, 24) == pytest.approx(0.005227, abs=1e-6)
    assert stats.student_two_tailed(0.0, 10) == pytest.approx(1.0)
    assert stats.normal_below(0) == 0.5
    assert math.isclose(stats.normal_below(-1.96), 0.025, abs_tol=1e-4)


def test_paired_t_without_spread(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    assert stats.paired_t(df, "a", "b").first()["t_stat"] == 1e9
    assert stats.paired_t(df, "a", "a").first()["t_stat"] == 0.0


def test_bootstrap_is_independent_of_partitions(spark):
    df = spark.createDataFrame([("g", i, float(i * i % 7)) for i in range(12)] + [("small", 1, 2.0)], "g string, o int, v double")
    a = sorted(map(tuple, stats.bootstrap_interval(df, "v", ["g"], "o").collect()))
    b = sorted(map(tuple, stats.bootstrap_interval(df.repartition(3), "v", ["g"], "o").collect()))
    assert a == b
    assert a[1] == ("small", 1, None, None)


def test_text_functions(spark):
    assert one(spark, text.one_spaced(F.lit("﻿ a \n\t b "))) == "a b"
    assert one(spark, text.sentences(F.lit("One. Two!  Three\nFour ;,"))) == ["One.", "Two!", "Three", "Four"]
    assert one(spark, text.sentences(F.lit(None).cast("string"))) == []
    blocks = one(spark, text.located_blocks(F.lit("[TITLE] Head [NEWS_P001] Body one. [NEWS_P002]  ")))
    assert [tuple(b) for b in blocks] == [("[TITLE]", "Head"), ("[NEWS_P001]", "Body one.")]
    assert one(spark, text.token_estimate(F.lit("it's 1,000.5 ok!"))) == 4
    assert one(spark, text.token_estimate(F.lit(""))) == 0
    assert one(spark, text.keyword_count(F.lit("RM5 profit, profitable 3%"), ["rm", "profit", "%", "fit"])) == 3
    assert one(spark, text.plain_html(F.lit("<p>a&amp;b</p>\n<script>x</script>\nAdvertisement\n\n\n\nc"))) == "a&b\n\nc"
    assert one(spark, text.source_of(F.lit("https://www.News.example.org/x"))) == "news.example.org"
    assert one(spark, text.packed(F.array(*[F.lit(x) for x in ("aaa", "bbb", "c")]), 5)) == ["aaa bbb", "c"]


def test_dates(spark):
    for raw, want in [("2024-03-05 10:00:00", "2024-03-05"), ("05/03/2024", "2024-03-05"), ("5 March 2024", "2024-03-05"), ("seen 2023-1-9 x", "2023-01-09"), ("about 2021", "2021"), ("", "")]:
        assert one(spark, dates.iso_date(F.lit(raw))) == want
    when = lambda d: one(spark, dates.time_alignment(F.lit(2023), F.lit(d).cast("date")))
    assert [when(d) for d in ("2022-12-31", "2023-01-01", "2024-06-30", "2024-07-01", None)] == ["pre_mda", "same_period", "post_mda", "outside_window", "unknown"]


STATEMENTS = [
        ("Revenue increased by 20% from RM100 million to RM120 million.", ["consistent"]),
        ("Revenue increased by 50% from RM100 million to RM120 million.", ["material_discrepancy"]),
        ("Revenue decreased by 20% from RM100 million to RM120 million.", ["severe_direction_conflict"]),
        ("Profit improved by 10% from (RM5 million) to RM2 million.", ["special_case_negative_base"]),
        ("Profit rose by 10% from RM0 million to RM2 million.", ["not_calculable_previous_zero"]),
        ("The group recorded 18% increase in revenue of RM515.615 million in FY2021 as compared with RM436.166 million in FY2020.", ["consistent"]),
        ("[MDA_P001] Gross profit margin was 30% with gross profit of RM20 million and revenue of RM100 million.", ["material_discrepancy"]),
        ("[MDA_P002] Segment revenue from food was RM60 million and beverages was RM40 million, for total segment revenue of RM120 million.", ["material_discrepancy"]),
        ("Nothing to check.", []),
    ]


def test_numeric_checks(spark):
    docs = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(STATEMENTS)], "document_id int, text string")
    got = {i: [] for i in range(len(STATEMENTS))}
    for r in numeric.numeric_checks(docs).collect():
        got[r["document_id"]].append(r["status"])
    assert [got[i] for i in range(len(STATEMENTS))] == [want for _, want in STATEMENTS]


def test_numeric_summary_keeps_documents_without_checks(spark):
    docs = spark.createDataFrame([("a", "Revenue increased by 20% from RM100 million to RM120 million. Profit fell by 10% from RM50 million to RM45 million."), ("b", None), ("c", "")], "document_id string, text string")
    out = {r["document_id"]: r for r in numeric.document_summary(docs, numeric.numeric_checks(docs)).collect()}
    assert out["a"]["overall_numeric_consistency"] == "strong"
    assert out["b"]["overall_numeric_consistency"] == out["c"]["overall_numeric_consistency"] == "not_enough_numbers"


@pytest.mark.parametrize(
    "raw,kind",
    [('{"a": 1}', ""), ('```json\n{"a": 1}\n```', "markdown_wrapped_json"), ('<think>x</think>{"a": 1}', "think_block_before_json"), ('Sure: {"a": 1} done', "leading_or_trailing_text"), ('{"a": 0} {"a": 1, "b": 2}', "multiple_json_objects"), ("{'a': 1}", "invalid_escape_or_quote"), ('{"a": 1,}', "missing_comma_or_brace")],
)
def test_json_is_read(raw, kind):
    ok, payload, failure, _ = jsonfix.read(raw)
    assert ok and failure == kind and '"a": 1' in payload


@pytest.mark.parametrize("raw,kind", [("", "empty_response"), (None, "empty_response"), ("no json", "not_json"), ("timed out", "timeout_or_no_response"), ('{"a": 1', "truncated_json")])
def test_json_is_not_read(raw, kind):
    ok, payload, failure, _ = jsonfix.read(raw)
    assert not ok and payload is None and failure == kind


def test_payload_issues(spark):
    issues = lambda p: one(spark, jsonfix.payload_issues(F.lit(p)))
    assert issues('{"score": 3, "evidence": "[MDA_P001]", "reason": "ok"}') == []
    assert issues('{"score": 9, "evidence": "page 3", "reason": ""}') == ["evidence_not_a_locator", "missing_reason", "score_out_of_range"]


def test_claims(spark):
    docs = spark.createDataFrame([("d", "[MDA_P001]\nRevenue increased 5% due to export growth and lower costs.\n[MDA_P002] Risk."), ("e", None)], "document_id string, text string")
    rows = claims.extracted(docs, "mda").orderBy("claim_id").collect()
    assert [r["claim_type"] for r in rows] == ["financial_claim", "causal_claim", "causal_claim", "cost_claim", "segment_claim", "risk_claim"]
    assert rows[0]["claim_id"] == "d_CL0001" and rows[0]["claim_text"] == "Revenue increased 5%" and rows[0]["value"] == "5%"
    assert rows[-1]["evidence_locator"] == "[MDA_P002]"
    assert {r["document_id"] for r in rows} == {"d"}


def test_greedy_dedupe_against_fold(spark):
    rng = random.Random(9)
    rows = [(i, f"h{rng.randint(0, 12)}", f"t{rng.randint(0, 12)}" if rng.random() < 0.9 else None, rng.random() < 0.8) for i in range(80)]
    want, hashes, titles = {}, set(), set()
    for i, h, t, ok in rows:
        want[i] = ok and h not in hashes and t not in titles
        if want[i]:
            hashes.add(h)
            titles |= {t} - {None}
    df = spark.createDataFrame(rows, "i int, h string, t string, ok boolean")
    got = dedupe.greedy_dedupe(df, ["h", "t"], "i", "ok", keeper(spark, "test"))
    assert {r["i"]: r["included"] for r in got.collect()} == want


def test_alias_borders(spark):
    a = spark.createDataFrame([(1, "ABC", "abc rises, XABC not"), (2, "ABC", "xabc only"), (3, "DEF", "abc")], "id int, g string, text string")
    aliases = spark.createDataFrame([("ABC", "ABC"), ("DEF", "d.f")], "ticker string, alias string")
    got = {r["id"]: r["hits"] for r in relevance.own_alias_hits(a, aliases, F.col("text"), id_col="id", group_col="g").collect()}
    assert got == {1: ["ABC"]}
    table = relevance.alias_table(spark.createDataFrame([("abc", "1234", "Good Foods Berhad")], "ticker string, stock_code string, company_name string"))
    assert {(r["alias"], r["match_strength"]) for r in table.collect()} == {("Good Foods Berhad", "strong"), ("Good Foods", "medium"), ("ABC", "weak"), ("1234", "weak")}


def test_gates_and_exclusions(spark):
    m = spark.createDataFrame([(0.97, None)], "rate double, other double")
    g = gates.quality_gates(m, [("rate", "min", 0.95), ("other", "max", 0.1)])
    assert gates.all_passed(g, ["rate", "other"]).first()["blockers"] == ["other"]
    df = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "d int, x int")
    out = {r["d"]: r["reasons"] for r in gates.exclusions(df, "d", {"bad": F.col("x") == 1}).collect()}
    assert out == {1: "bad", 2: ""}


def test_budget_prefix_keeps_the_first(spark):
    df = spark.createDataFrame([(1, 0, 500, 10), (1, 1, 5, 10), (2, 0, 5, 10), (2, 1, 5, 10), (2, 2, 500, 10)], "d int, o int, k int, n int")
    got = sorted((r["d"], r["o"]) for r in context.budget_prefix(df, "d", "o", "k", "n", 20).collect())
    assert got == [(1, 0), (2, 0), (2, 1)]


def test_fundamentals(spark):
    docs = spark.createDataFrame([("a", "Cover\fStatement\nTotal assets 2023 (1,200)\nother"), ("b", "x\fTotal assets\n3,400 5")], "document_id string, text string")
    got = {r["document_id"]: r["value"] for r in fundamentals.labelled_figure(fundamentals.pages(docs), "total assets").collect()}
    assert got == {"a": -1200.0, "b": 3400.0}
    votes = spark.createDataFrame([("x", "k")] * 4 + [("x", "e")] * 2 + [("y", "k"), ("y", "e")], "g string, v string")
    assert [tuple(r) for r in fundamentals.majority(votes, "g", "v").collect()] == [("x", "k", 4)]
    d = spark.createDataFrame([("p", "Independent Auditors' Report by Klm PLT"), ("q", "Auditors: Efg PLT")], "document_id string, text string")
    assert {r["document_id"]: (r["auditor"], r["found_by"]) for r in fundamentals.auditor(d, ["Klm PLT", "Efg PLT"]).collect()} == {"p": ("klm plt", "report"), "q": ("efg plt", "label")}


def test_results_do_not_depend_on_row_order(spark):
    rows = [(i % 5, "D1", i % 3 + 1, i) for i in range(40)]
    df = spark.createDataFrame(rows, "d int, c string, v int, o int")
    a = sorted(map(tuple, scoring.first_values(df, ["d", "c"], "o", "v").collect()))
    b = sorted(map(tuple, scoring.first_values(df.orderBy(F.desc("o")).repartition(5), ["d", "c"], "o", "v").collect()))
    assert a == b
