"""Queries on statements that are written out of `orders`, so that what they should yield follows from the numbers.

Each order gives a text with a stated change, margin or sum of known amounts, and a
sentence of another kind. The SQL works on the numbers, never on the texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.operators import claims as C
from scorewright.operators import jsonfix as J
from scorewright.operators import numeric as N
from scorewright.plans.ratings import table
from scorewright.sources.tables import spread

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Numbers of an order's statement: kind, stated percentage, amounts before, after and in all, and whether the first is a loss.
NUMBERS = {"kind": "o_orderkey % 5", "stated": "o_orderkey % 53", "old": "o_custkey % 97", "new": "(o_orderkey * 7 + o_custkey) % 211", "whole": "o_custkey % 97 + (o_orderkey * 7 + o_custkey) % 211 + o_orderkey % 13 - 6", "loss": "o_orderkey % 7"}
METRIC, WAYS = "net profit", ("increased", "decreased")
#: Sentences that follow, by order, and the claim that each is.
TAILS = ("Packaging is dear", "The export segment did well", "Competition is a risk", "The outlook is cautious", "Expansion is part of the strategy")
KINDS = ("cost_claim", "segment_claim", "risk_claim", "outlook_claim", "strategy_claim")


def statements(spark, sf_dir):
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select(F.col("o_orderkey").cast("string").alias("document_id"), "o_orderkey", *[F.expr(f"cast({e} as long)").alias(n) for n, e in NUMBERS.items()])
    rm = lambda c: F.concat(F.lit("RM"), F.col(c).cast("string"), F.lit(" million"))
    before = F.when((F.col("loss") == 0) & (F.col("old") > 0), F.concat(F.lit("(RM"), F.col("old").cast("string"), F.lit(" million)"))).otherwise(rm("old"))
    way = F.when(F.col("o_orderkey") % 2 == 0, WAYS[0]).otherwise(WAYS[1])
    changed = F.concat(F.lit(f"{METRIC.capitalize()} "), way, F.lit(" by "), F.col("stated").cast("string"), F.lit("% from "), before, F.lit(" to "), rm("new"), F.lit(". "))
    margin = F.concat(F.lit("Gross profit margin was "), F.col("stated").cast("string"), F.lit("% with gross profit of "), rm("old"), F.lit(" and revenue of "), rm("new"), F.lit(". "))
    total = F.concat(F.lit("Segment revenue from food was "), rm("old"), F.lit(" and beverages was "), rm("new"), F.lit(", for total segment revenue of "), rm("whole"), F.lit(". "))
    tail = F.concat(F.element_at(F.array(*[F.lit(t) for t in TAILS]), (F.col("o_orderkey") % len(TAILS) + 1).cast("int")), F.lit("."))
    text = F.concat(F.when(F.col("kind") == 3, margin).when(F.col("kind") == 4, total).otherwise(changed), tail)
    return o.select("document_id", text.alias("text"))


_NUMBERS_SQL = ", ".join(f"({e})::DOUBLE AS {n}" for n, e in NUMBERS.items())
_CLOSE = "CASE WHEN abs({a} - {b}) <= 1 THEN 'consistent' WHEN abs({a} - {b}) <= 3 THEN 'minor_discrepancy' ELSE 'material_discrepancy' END"
_CHECKS_SQL = f"""o AS (SELECT o_orderkey::VARCHAR AS document_id, o_orderkey % 2 = 0 AS up, {_NUMBERS_SQL} FROM orders),
a AS (SELECT *, CASE WHEN kind < 3 AND loss = 0 AND old > 0 THEN -old ELSE old END AS base FROM o),
v AS (SELECT *, CASE WHEN kind < 3 AND base <> 0 THEN round((new - base) / abs(base) * 100, 6) WHEN kind = 3 AND new <> 0 THEN round(old / abs(new) * 100, 6) END AS value, CASE WHEN kind = 4 AND whole <> 0 THEN round((old + new - whole) / abs(whole) * 100, 6) END AS off FROM a),
k AS (SELECT document_id, '{METRIC}' AS metric, CASE WHEN up THEN '{WAYS[0]}' ELSE '{WAYS[1]}' END AS direction_word, stated AS stated_pct, base AS previous_value, new AS current_value, value AS calculated,
  CASE WHEN value IS NULL THEN 'not_calculable_previous_zero' WHEN base < 0 THEN 'special_case_negative_base' WHEN up AND value < 0 OR NOT up AND value > 0 THEN 'severe_direction_conflict' ELSE {_CLOSE.format(a='CASE WHEN up THEN stated ELSE -stated END', b='value')} END AS status FROM v WHERE kind < 3
UNION ALL SELECT document_id, 'margin', '', stated, new, old, value, CASE WHEN new = 0 THEN 'not_calculable_previous_zero' ELSE {_CLOSE.format(a='stated', b='value')} END FROM v WHERE kind = 3
UNION ALL SELECT document_id, 'segment revenue', '', 0, whole, old + new, CASE WHEN whole <> 0 THEN old + new END, CASE WHEN whole = 0 THEN 'not_calculable_previous_zero' WHEN abs(off) > 1000 THEN 'needs_manual_review' ELSE {_CLOSE.format(a='0', b='off')} END FROM v WHERE kind = 4)"""


@query(f"WITH {_CHECKS_SQL} SELECT * FROM k")
def order_statement_checks(spark, sf_dir):
    """Stated changes, margins and sums of every order's statement, judged."""
    return N.numeric_checks(statements(spark, sf_dir)).drop("source_text", "evidence_locator")


@query(f"""WITH {_CHECKS_SQL} SELECT document_id, (CASE WHEN kind < 3 THEN 3 WHEN kind = 3 THEN 6 ELSE 4 END)::BIGINT AS num_financial_mentions,
(status = 'consistent')::BIGINT AS num_consistent, (status = 'minor_discrepancy')::BIGINT AS num_minor, (status = 'material_discrepancy')::BIGINT AS num_material, (status = 'severe_direction_conflict')::BIGINT AS num_conflicts, (status IN ('not_calculable_previous_zero', 'special_case_negative_base', 'needs_manual_review'))::BIGINT AS num_not_calculable,
CASE status WHEN 'severe_direction_conflict' THEN 'problematic' WHEN 'material_discrepancy' THEN 'weak' ELSE 'moderate' END AS overall_numeric_consistency, CASE status WHEN 'severe_direction_conflict' THEN 1 WHEN 'material_discrepancy' THEN 2 WHEN 'consistent' THEN 4 ELSE 3 END::INTEGER AS numeric_score
FROM k JOIN o USING (document_id)""")
def order_statement_summary(spark, sf_dir):
    """Counts, label and score of every order's statement."""
    s = statements(spark, sf_dir)
    return N.document_summary(s, N.numeric_checks(s))


@query(f"""WITH o AS (SELECT o_orderkey::VARCHAR AS document_id, o_orderkey % 5 AS kind, o_orderkey % 2 = 0 AS up FROM orders),
c AS (SELECT document_id, 1 AS place, kind, 'financial_claim' AS claim_type, CASE WHEN kind < 3 THEN CASE WHEN up THEN 'increase' ELSE 'decrease' END ELSE 'neutral' END AS direction FROM o
UNION ALL SELECT document_id, 2, kind, 'segment_claim', 'neutral' FROM o WHERE kind = 4
UNION ALL SELECT document_id, 3, kind, list_extract({list(KINDS)}, (kind + 1)::BIGINT), CASE WHEN kind = 3 THEN 'decrease' ELSE 'neutral' END FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY place) AS nth FROM c)
SELECT document_id || '_CL' || lpad(nth::VARCHAR, 4, '0') AS claim_id, document_id, claim_type, direction, '[MDA_P001]' AS evidence_locator FROM n""")
def order_statement_claims(spark, sf_dir):
    """Claims of every order's statement, numbered in order."""
    return C.extracted(statements(spark, sf_dir), "mda").select("claim_id", "document_id", "claim_type", "direction", "evidence_locator")


#: Ways to wrap a payload, and what the reader should say about each.
WRAPPED = (("markdown_wrapped_json", "strip_markdown_and_parse"), ("think_block_before_json", "strip_think_block_and_parse"), ("leading_or_trailing_text", "extract_largest_json_object"), ("invalid_escape_or_quote", "repair_json"), ("missing_comma_or_brace", "repair_json"), ("truncated_json", "repair_json"), ("multiple_json_objects", "extract_largest_json_object"))


@query(f"""SELECT event_id, event_id % 7 <> 5 AS ok, CASE WHEN event_id % 7 <> 5 THEN props ->> '$.k' END AS k, list_extract({[a for a, _ in WRAPPED]}, (event_id % 7 + 1)::BIGINT) AS failure_type, list_extract({[b for _, b in WRAPPED]}, (event_id % 7 + 1)::BIGINT) AS recommended_fix FROM events""")
def json_repair_outcomes(spark, sf_dir):
    """Every event's payload in one of seven broken wrappings: whether it is read, what it holds, and what was wrong."""
    e, p = table(spark, sf_dir, "events").select("event_id", "props"), F.col("props")
    wraps = [F.concat(F.lit("```json\n"), p, F.lit("\n```")), F.concat(F.lit("<think>hm</think>"), p), F.concat(F.lit("Answer: "), p, F.lit(" done")), F.replace(p, F.lit('"'), F.lit("'")), F.regexp_replace(p, "}$", ",}"), F.regexp_replace(p, "}$", ""), F.concat(F.lit("{} "), p)]
    raw = F.element_at(F.array(*wraps), (F.col("event_id") % len(wraps) + 1).cast("int"))
    return J.stabilized(e.select("event_id", raw.alias("raw")), "raw").select("event_id", "ok", F.get_json_object("payload", "$.k").alias("k"), "failure_type", "recommended_fix")
