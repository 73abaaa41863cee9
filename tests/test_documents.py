"""Cleaning, cutting, prompts, payloads, registry rules and link claims on crafted rows."""

import json

from pyspark.sql import functions as F

from scorewright.operators import claims, crossval, jsonfix, registry
from scorewright.operators import documents as D

CODES = ["AR01", "AR02", "AR03", "AR04", "AR05"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_report_cleaning(spark):
    text = "Annual Report 2023\r\n12\nFINANCIAL REVIEW\nThe busi-\nness did well.\n\nSame words.\n\nSame words.\n\nRevenue RM5.\n\nRevenue RM5.\n\nOutlook\nBright.\x07"
    docs = spark.createDataFrame([("d", text), ("e", None), ("f", "")], "document_id string, text string")
    rows = [(r["paragraph"], r["section"], r["text"]) for r in D.cleaned(docs).orderBy("paragraph").collect()]
    assert rows == [("MDA_P001", "financial review", "The business did well."), ("MDA_P002", "financial review", "Same words."), ("MDA_P003", "financial review", "Revenue RM5."), ("MDA_P004", "financial review", "Revenue RM5."), ("MDA_P005", "outlook", "Bright.")]


def test_article_paragraphs(spark):
    assert one(spark, D.article_paragraphs(F.lit(" A  title "), F.lit("One.\n\nTwo."))) == "[TITLE]\nA title\n\n[NEWS_P001] One.\n\n[NEWS_P002] Two.\n"
    packed = one(spark, D.article_paragraphs(F.lit("t"), F.lit("Aaa. Bbb. Ccc."), 6))
    assert packed == "[TITLE]\nt\n\n[NEWS_P001] Aaa. Bbb.\n\n[NEWS_P002] Ccc.\n"


def test_small_text_rules(spark):
    assert one(spark, D.notes_map(F.lit("a=1; b = x=y ;c; a=2"))) == {"b": "x=y", "a": "2"}
    assert one(spark, D.plain_signs(F.lit("ﬁne – “ok”"))) == 'fine - "ok"'
    assert one(spark, D.placeholder(F.lit("https://a.b/c"), F.lit(""), F.lit("")))
    assert one(spark, D.shortened(F.lit("a  b c"), 4)) == "a b"
    assert one(spark, D.heading(F.lit("CHAIRMAN'S NOTE"))) and not one(spark, D.heading(F.lit("A plain sentence.")))
    assert one(spark, D.ingest_reasons(F.lit("x"), F.lit(""), F.lit(""), F.lit(None).cast("date"), F.lit(False))) == ["short_article_text", "invalid_publish_date"]
    assert one(spark, D.ingest_reasons(F.lit("x"), F.lit(""), F.lit(""), F.lit(None).cast("date"), F.lit(True))) == ["duplicate"]


def test_prompt_takes_a_tone_once(spark):
    p = one(spark, D.prompt(F.lit("Do. Example: 1 Example: 2"), F.struct(F.lit(1).alias("id")), F.lit("ctx"), tone="Strictly. "))
    assert p == 'Do. Strictly. Example: 1 Example: 2\nMETADATA:\n{"id":1}\n\nCONTEXT:\nctx'


def test_full_payload(spark):
    dims = [{"dimension_code": c, "raw_score": 3, "reason": "r", "evidence_locator": "[MDA_P001]", "confidence_level": "high"} for c in CODES]
    good = {"document_id": "d", "doc_type": "mda", "scoring_basis": "b", "scorebook_version": "1", "evidence_limitation": "", "dimension_scores": dims, "flags": {"f": 0}, "overall_comment": "", "needs_review": False, "review_reasons": []}
    issues = lambda p: one(spark, D.full_payload_issues(F.lit(p if isinstance(p, str) else json.dumps(p)), CODES, ["f"]))
    assert issues(good) == []
    assert issues("{") == ["json_parse_failed"]
    bad = {**good, "flags": {"f": 2}, "dimension_scores": dims[::-1][:4], "overall_comment": "matches the audited financial statements"}
    del bad["needs_review"]
    assert issues(bad) == ["dimension_codes_not_expected_order", "dimension_count_not_5", "invalid_flag_f", "missing_top_field_needs_review", "scope_violation"]


def test_registry_rules(spark):
    stage = one(spark, registry.failure_stage(F.lit("json_parse error"), F.lit("ok"), F.lit("valid"), F.lit(100), F.lit("valid"), F.lit("ok"), F.lit(0)))
    assert tuple(stage) == ("json_parse", "repair_json_and_retry")
    e = one(spark, registry.evidence_class(F.lit("AR02"), F.lit("Registered office: here"), F.lit("")))
    assert e["issue"] == "non_mda_noise"
    assert one(spark, registry.evidence_class(F.lit("AR03"), F.lit("growth due to demand"), F.lit("")))["status"] == "strong"
    issues = one(spark, registry.rating_issues(F.lit("AR02"), F.lit("7"), F.lit(""), F.lit(False), F.lit(""), F.lit("LOW"), F.lit("matches the audited financial statements"), F.lit(1)))
    assert issues == ["raw_score_out_of_range", "evidence_locator_invalid", "ar02_external_verification_claim", "empty_evidence", "numeric_check_conflict", "low_confidence"]
    assert one(spark, registry.scope_violation(F.lit(None).cast("string"), F.lit("x,WRONG_COMPANY"), F.lit(None).cast("string")))
    df = spark.createDataFrame([("1", "a", None), ("2", None, "b")], "document_id string, x string, y string")
    assert [tuple(r) for r in registry.filled(df, {"x": "d"}).orderBy("document_id").collect()] == [("1", "a", None), ("2", "d", "b")]
    assert registry.unscored(df, CODES).count() == 10


def test_link_claims_and_relations(spark):
    text = "Revenue increased in 2024 as demand improved. Raw material costs rose. [MDA_P003] We take a cautious outlook. Hello. Company said food safety is fine; revenue fell then increased."
    docs = spark.createDataFrame([("m", text), ("n", None)], "document_id string, text string")
    rows = claims.link_claims_of(docs, "news").orderBy("claim_id").collect()
    got = [(r["topic"], r["direction"], r["evidence_locator"], r["source_independence"]) for r in rows]
    assert got == [("revenue", "increased", "S001", "unknown"), ("raw_material", "increased", "S002", "unknown"), ("consumer_demand", "cautious", "MDA_P003", "unknown"), ("revenue", "decreased", "S005", "low")]
    links = spark.createDataFrame(
        [(1, "food_safety", "risk", "negative", "high", False, None, None, None, None), (2, "consumer_demand", "outlook", "optimistic", "medium", False, "c", "consumer_demand", "outlook", "cautious"), (3, "revenue", "financial_result", "increased", "low", True, "c", "revenue", "financial_result", "increased"), (4, "revenue", "financial_result", "decreased", "high", False, "c", "revenue", "financial_result", "increased"), (5, "revenue", "financial_result", "increased", "unknown", False, "c", "revenue", "financial_result", "increased")],
        "k int, topic string, claim_type string, direction string, source_independence string, company_source boolean, m_claim_id string, m_topic string, m_type string, m_direction string",
    ).withColumns({"publish_date": F.lit("2024-03-01").cast("date"), "report_year": F.lit(2024)})
    out = {r["k"]: (r["relation_type"], r["support_level"]) for r in crossval.relation(links).collect()}
    assert out == {1: ("possible_omission", "unknown"), 2: ("qualification", "weak"), 3: ("same_source_repetition", "moderate"), 4: ("contradiction", "conflicting"), 5: ("partial_support", "moderate")}


def test_nesting_beyond_reading_is_a_failure_of_its_row(spark):
    rows = [(1, "[" * 100_000), (2, '{"a": 1}'), (3, '{"a":' * 100_000), (4, "'{" + '"a":' * 50_000 + "}")]
    got = {r["i"]: (r["ok"], r["failure_type"]) for r in jsonfix.stabilized(spark.createDataFrame(rows, "i int, raw string"), "raw").collect()}
    assert got[1] == got[3] == (False, "nested_too_deeply") and got[2] == (True, "") and not got[4][0]
