"""Queries on small tables of their own: every row of the input counts."""

from collections import Counter

from scorewright.operators import claims, numeric
from scorewright.operators.registry import EVIDENCE_WORDS
from scorewright.plans.registry import QUERIES
from scorewright.plans.texts import NEWS_SENTENCES, REPORT_SENTENCES


def test_claims_come_from_all_documents_and_turns(spark, tmp_path):
    spark.createDataFrame([(i * 10 + k, t) for i in range(3) for k, (_, t) in enumerate(REPORT_SENTENCES)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, k, t) for k, (_, t) in enumerate(NEWS_SENTENCES)] + [(None, 0, "Profit fell."), (8, 0, None)], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    run = lambda name: QUERIES[name](spark, str(tmp_path))
    schema = "document_id string, text string"
    reports = spark.createDataFrame([(str(i * 10 + k), t) for i in range(3) for k, (_, t) in enumerate(REPORT_SENTENCES)], schema)
    news = spark.createDataFrame([(f"7_T{k}", t) for k, (_, t) in enumerate(NEWS_SENTENCES)] + [("null_T0", "Profit fell.")], schema)
    rows = lambda df: Counter(map(tuple, df.collect()))
    want = claims.extracted(reports, "mda").unionByName(claims.extracted(news, "news"))
    assert rows(run("claims_extracted")) == rows(want)
    assert rows(run("link_claims_extracted")) == rows(claims.link_claims_of(reports, "mda").unionByName(claims.link_claims_of(news, "news")))
    assert rows(run("claim_rule_scores")) == rows(want.select("claim_id", "claim_type", claims.rule_score(want)))
    assert rows(run("numeric_change_checks")) == rows(numeric.numeric_checks(reports))
    counts = Counter((r["claim_type"], r["direction"]) for r in claims.extracted(reports, "mda").collect() if r["claim_type"] != "causal_claim")
    assert {(r["claim_type"], r["direction"]): r["n"] for r in run("claim_type_counts").collect()} == counts


def test_evidence_counts_wherever_it_stands(spark, tmp_path):
    rows = [(1, "x" * 300 + " " + " ".join(EVIDENCE_WORDS["AR04"][:2])), (2, "x" * 300), (3, None), (4, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["status"] for r in QUERIES["evidence_semantics"](spark, str(tmp_path)).collect()}
    assert got == {1: "strong", 2: "weak", 3: "not_checkable", 4: "not_checkable"}


def test_lookup_covers_all_orders(spark, tmp_path):
    spark.createDataFrame([(299,), (300,), (70_000,), (5,)], "o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, 300, 9), (2, 300, 300 % 7), (3, 70_000, 9), (4, 299, 1)], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r["p"], r["k"]) for r in QUERIES["two_pass_lookup"](spark, str(tmp_path)).collect()}
    assert got == {(299, 4), (300, 2), (70_000, 3), (5, None)}


def test_short_phrases_are_found(spark, tmp_path):
    texts = {1: "alpha beta gamma", 2: "xalpha betaz", 3: "alpha  beta", 4: "of the of the", 5: "b", 6: "", 7: None}
    phrases = {1: "alpha beta", 2: "gamma", 3: "of the of", 4: "b", 5: "zz", 6: "", 7: "alpha gamma"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(phrases.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r["item_id"], r["doc_id"]): r["place"] for r in QUERIES["phrase_containment"](spark, str(tmp_path)).collect()}
    assert got == {(i, d): t.index(p) + 1 for i, p in phrases.items() if p for d, t in texts.items() if t and p in t}
