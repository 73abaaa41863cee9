"""Queries that link reports and news, years and runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from scorewright.operators import crossval as X
from scorewright.operators import gates as G
from scorewright.plans import ratings as R
from scorewright.plans.ratings import CODES, SQL_COMPANIES, SQL_WIDE, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TOPICS = ["revenue", "raw_material", "margin", "capacity_expansion", "strategy", "food_safety", "consumer_demand", "cost"]
TYPES = ["financial_result", "cost_pressure", "margin", "expansion", "risk", "outlook"]
WAYS = ["increased", "decreased", "cautious", "optimistic", "unknown"]
SOURCES = ["high", "medium", "low", "unknown"]


def _pick(names: list[str], i) -> F.col:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (i % len(names) + 1).cast("int"))


def _sql_pick(names: list[str], i: str) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][(({i}) % {len(names)} + 1)::INTEGER]"


_REPORTS = "reports AS (SELECT DISTINCT o_custkey * 10000 + year(o_orderdate) AS mda_document_id, o_custkey AS ticker, year(o_orderdate)::INTEGER AS report_year, o_custkey * 10000 + year(o_orderdate) AS mda_ord FROM orders)"
_NEWS = f"""news AS (SELECT event_id AS news_claim_id, event_id // 3 AS news_document_id, user_id AS ticker, make_date((1995 + event_id % 8)::INTEGER, (1 + event_id % 12)::INTEGER, (1 + event_id % 28)::INTEGER) AS publish_date,
  {_sql_pick(TOPICS, 'event_id * 3 + user_id')} AS topic, {_sql_pick(TYPES, 'event_id + user_id')} AS claim_type, {_sql_pick(TOPICS, 'event_id * 3 + user_id')} AS metric_name, {_sql_pick(WAYS, 'event_id // 2')} AS direction, {_sql_pick(SOURCES, 'event_id // 5')} AS source_independence, event_type = 'click' AS company_source FROM events)"""
_MDA = f"""mda AS (SELECT o_orderkey AS claim_id, o_custkey * 10000 + year(o_orderdate) AS mda_document_id, {_sql_pick(TOPICS, 'o_orderkey')} AS topic, {_sql_pick(TYPES, 'o_orderkey // 2')} AS claim_type, {_sql_pick(TOPICS, 'o_orderkey')} AS metric_name, {_sql_pick(WAYS, 'o_orderkey // 3')} AS direction, o_orderkey AS claim_ord FROM orders)"""
_ALIGN = "CASE WHEN year(publish_date) < report_year THEN 'pre_mda' WHEN year(publish_date) = report_year THEN 'same_period' WHEN year(publish_date) = report_year + 1 AND month(publish_date) <= 6 THEN 'post_mda' ELSE 'outside_window' END"
_BEST = f"""{_REPORTS}, {_NEWS}, best AS (SELECT * FROM (SELECT n.*, mda_document_id, report_year, {_ALIGN} AS time_alignment, row_number() OVER (PARTITION BY news_claim_id ORDER BY CASE WHEN {_ALIGN} IN ('same_period', 'post_mda') THEN 2 ELSE 1 END + CASE WHEN year(publish_date) = report_year THEN 1 ELSE 0 END DESC, mda_ord) AS k FROM news n JOIN reports USING (ticker)) WHERE k = 1)"""


def _close(a: str, b: str) -> str:
    return f"({a} = {b} OR " + " OR ".join("({0} IN ({2}) AND {1} IN ({2}))".format(a, b, ", ".join(f"'{x}'" for x in g)) for g in X.TOPIC_GROUPS) + ")"


def _types(a: str, b: str) -> str:
    g = ", ".join(f"'{x}'" for x in X.CLOSE_TYPES)
    return f"({a} = {b} OR ({a} IN ({g}) AND {b} IN ({g})))"


def _conflict(a: str, b: str) -> str:
    up, down = (", ".join(f"'{x}'" for x in g) for g in (X.UP, X.DOWN))
    return f"(({a} IN ({up}) AND {b} IN ({down})) OR ({a} IN ({down}) AND {b} IN ({up})))"


_LINKS = f"""{_BEST}, {_MDA}, cand AS (SELECT b.news_claim_id, m.claim_id AS m_claim_id, m.topic AS m_topic, m.claim_type AS m_type, m.direction AS m_direction, {_close('m.topic', 'b.topic')} AS near,
  CASE WHEN m.topic = b.topic THEN 3 ELSE 0 END + CASE WHEN m.claim_type = b.claim_type THEN 2 ELSE 0 END + CASE WHEN m.metric_name <> '' AND m.metric_name = b.metric_name THEN 2 ELSE 0 END + CASE WHEN {_conflict('m.direction', 'b.direction')} THEN 4 ELSE 0 END + CASE WHEN m.direction = 'cautious' AND b.direction = 'optimistic' THEN 4 ELSE 0 END AS score, m.claim_ord
  FROM best b JOIN mda m USING (mda_document_id) WHERE {_close('m.topic', 'b.topic')} OR {_types('m.claim_type', 'b.claim_type')}),
linked AS (SELECT b.*, c.m_claim_id, c.m_topic, c.m_type, c.m_direction FROM best b LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY news_claim_id ORDER BY near DESC, score DESC, claim_ord) AS k FROM cand) WHERE k = 1) c USING (news_claim_id))"""
_REL = f"""{_LINKS}, rel AS (SELECT *, CASE WHEN m_claim_id IS NULL AND (claim_type IN ('risk', 'regulation') OR topic IN ('food_safety', 'regulation')) THEN ['possible_omission', 'news_contextualizes_mda', 'unknown', 'omission']
  WHEN m_claim_id IS NULL THEN ['insufficient_evidence', 'no_direction', 'unknown', ''] WHEN source_independence = 'low' AND company_source THEN ['same_source_repetition', 'bidirectional_support', 'moderate', 'repetition']
  WHEN m_direction = 'cautious' AND direction = 'optimistic' THEN ['qualification', 'mda_qualifies_news', 'weak', 'overstatement'] WHEN {_conflict('m_direction', 'direction')} THEN ['contradiction', 'contradiction', 'conflicting', 'contradiction']
  WHEN claim_type = 'expansion' AND m_type = 'expansion' THEN ['strong_support', 'mda_supports_news', 'strong', ''] WHEN topic IN ('raw_material', 'supply_chain', 'foreign_exchange', 'consumer_demand', 'competition') THEN ['contextual_support', 'news_supports_mda', 'moderate', '']
  WHEN {_close('m_topic', 'topic')} AND m_direction = direction AND source_independence IN ('medium', 'high') THEN ['strong_support', 'bidirectional_support', 'strong', ''] WHEN {_close('m_topic', 'topic')} THEN ['partial_support', 'bidirectional_support', 'moderate', ''] ELSE ['no_clear_relation', 'no_direction', 'none', ''] END AS r FROM linked),
links AS (SELECT *, CASE WHEN r[3] = 'strong' AND time_alignment = 'outside_window' AND source_independence <> 'unknown' THEN 'partial_support' ELSE r[1] END AS relation_type, r[2] AS link_direction, CASE WHEN r[3] = 'strong' AND (source_independence = 'unknown' OR time_alignment = 'outside_window') THEN 'moderate' ELSE r[3] END AS support_level,
  (r[4] = 'contradiction')::INTEGER AS contradiction_flag, (r[4] = 'omission')::INTEGER AS omission_flag, (r[4] = 'overstatement')::INTEGER AS overstatement_flag, (r[4] = 'repetition')::INTEGER AS repetition_flag FROM rel)"""


def _reports(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.year("o_orderdate").alias("report_year")).distinct()
    key = F.col("ticker") * 10000 + F.col("report_year")
    return o.select(key.alias("mda_document_id"), "ticker", "report_year", key.alias("mda_ord"))


def _news(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    half = lambda n: F.floor(e / n)
    return table(spark, sf_dir, "events").select(e.alias("news_claim_id"), half(3).alias("news_document_id"), u.alias("ticker"), F.make_date((1995 + e % 8).cast("int"), (1 + e % 12).cast("int"), (1 + e % 28).cast("int")).alias("publish_date"), _pick(TOPICS, e * 3 + u).alias("topic"), _pick(TYPES, e + u).alias("claim_type"), _pick(TOPICS, e * 3 + u).alias("metric_name"), _pick(WAYS, half(2)).alias("direction"), _pick(SOURCES, half(5)).alias("source_independence"), (F.col("event_type") == "click").alias("company_source"))


def _mda_claims(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("claim_id"), (F.col("o_custkey") * 10000 + F.year("o_orderdate")).alias("mda_document_id"), _pick(TOPICS, k).alias("topic"), _pick(TYPES, F.floor(k / 2)).alias("claim_type"), _pick(TOPICS, k).alias("metric_name"), _pick(WAYS, F.floor(k / 3)).alias("direction"), k.alias("claim_ord"))


def _links(spark, sf_dir):
    best = X.best_documents(_news(spark, sf_dir), _reports(spark, sf_dir))
    return X.relation(X.linked_claims(best, _mda_claims(spark, sf_dir)))


@query(f"WITH {_BEST} SELECT news_claim_id, ticker, mda_document_id, report_year, time_alignment FROM best")
def best_match_document(spark, sf_dir):
    from scorewright.functions.dates import time_alignment

    best = X.best_documents(_news(spark, sf_dir), _reports(spark, sf_dir))
    return best.select("news_claim_id", "ticker", "mda_document_id", "report_year", time_alignment(F.col("report_year"), F.col("publish_date")).alias("time_alignment"))


@query(f"WITH {_LINKS} SELECT news_claim_id, mda_document_id, m_claim_id, m_topic, m_type FROM linked")
def two_tier_link(spark, sf_dir):
    best = X.best_documents(_news(spark, sf_dir), _reports(spark, sf_dir))
    return X.linked_claims(best, _mda_claims(spark, sf_dir)).select("news_claim_id", "mda_document_id", "m_claim_id", "m_topic", "m_type")


@query(f"WITH {_REL} SELECT news_claim_id, mda_document_id, relation_type, link_direction, support_level, contradiction_flag, omission_flag, overstatement_flag, repetition_flag, time_alignment, contradiction_flag + omission_flag + overstatement_flag + repetition_flag > 0 OR relation_type = 'insufficient_evidence' AS review_required FROM links")
def relation_classification(spark, sf_dir):
    return _links(spark, sf_dir).select("news_claim_id", "mda_document_id", "relation_type", "link_direction", "support_level", "contradiction_flag", "omission_flag", "overstatement_flag", "repetition_flag", "time_alignment", "review_required")


_PAIR = f"""{_REL}, agg AS (SELECT mda_document_id, count(DISTINCT news_document_id) AS num_related_news, count(*) AS num_claim_links, count(*) FILTER (relation_type = 'strong_support') AS num_strong_support, count(*) FILTER (relation_type = 'partial_support') AS num_partial_support, count(*) FILTER (relation_type = 'contextual_support') AS num_contextual_support,
  count(*) FILTER (relation_type = 'contradiction') AS num_contradictions, count(*) FILTER (relation_type = 'possible_omission') AS num_possible_omissions, count(*) FILTER (relation_type = 'same_source_repetition') AS num_same_source_repetitions, sum(overstatement_flag) AS num_news_overstatements,
  sum(CASE source_independence WHEN 'high' THEN 100 WHEN 'medium' THEN 67 WHEN 'low' THEN 33 ELSE 0 END)::BIGINT AS ind,
  max(CASE WHEN link_direction IN ('news_supports_mda', 'bidirectional_support') THEN CASE WHEN relation_type IN ('strong_support', 'contextual_support') THEN 4 ELSE 3 END ELSE 1 END) AS ms, max(CASE WHEN link_direction IN ('mda_supports_news', 'bidirectional_support') THEN CASE WHEN relation_type = 'strong_support' THEN 4 ELSE 3 END ELSE 1 END) AS ns FROM links GROUP BY 1),
p AS (SELECT r.mda_document_id, r.ticker, r.report_year, coalesce(num_related_news, 0)::BIGINT AS num_related_news, coalesce(num_claim_links, 0)::BIGINT AS num_claim_links, coalesce(num_strong_support, 0)::BIGINT AS num_strong_support, coalesce(num_partial_support, 0)::BIGINT AS num_partial_support, coalesce(num_contextual_support, 0)::BIGINT AS num_contextual_support, coalesce(num_contradictions, 0)::BIGINT AS num_contradictions, coalesce(num_possible_omissions, 0)::BIGINT AS num_possible_omissions, coalesce(num_same_source_repetitions, 0)::BIGINT AS num_same_source_repetitions, coalesce(num_news_overstatements, 0)::BIGINT AS num_news_overstatements, coalesce(ind, 0) AS ind, coalesce(ms, 1) AS ms, coalesce(ns, 1) AS ns FROM reports r LEFT JOIN agg USING (mda_document_id)),
pair AS (SELECT *, num_strong_support + num_contextual_support + num_partial_support AS sup, num_contradictions > 0 OR num_possible_omissions > 0 AS bad FROM p),
pairs AS (SELECT *, CASE WHEN bad THEN 1 WHEN num_news_overstatements > 0 THEN 2 WHEN sup >= 3 AND ind >= 60 * num_claim_links AND least(ms, ns) >= 3 THEN 5 WHEN sup >= 2 THEN 4 ELSE 3 END AS cross_validation_score,
  CASE WHEN bad THEN concat_ws(';', CASE WHEN num_contradictions > 0 THEN 'contradiction' END, CASE WHEN num_possible_omissions > 0 THEN 'possible_omission' END) WHEN num_news_overstatements > 0 THEN 'news_overstatement' ELSE '' END AS review_reasons FROM pair)"""


@query(f"""WITH {_PAIR} SELECT mda_document_id, ticker, report_year, num_related_news, num_claim_links, num_strong_support, num_partial_support, num_contextual_support, num_contradictions, num_possible_omissions, num_same_source_repetitions, num_news_overstatements, CASE WHEN num_claim_links > 0 THEN ((20 * ind + num_claim_links) // (2 * num_claim_links)) / 1000.0::DOUBLE ELSE 0.0::DOUBLE END AS avg_source_independence_score, ms AS mda_supported_by_news_score, ns AS news_supported_by_mda_score, cross_validation_score,
CASE WHEN cross_validation_score IN (1, 2) THEN 'D = contradiction / omission risk' WHEN cross_validation_score = 5 THEN 'A = strong triangulation' WHEN cross_validation_score = 4 THEN 'B = moderate triangulation' ELSE 'C = weak or neutral triangulation' END AS cross_validation_label, review_reasons <> '' AS review_required, review_reasons FROM pairs""")
def pair_summary(spark, sf_dir):
    return X.pair_summary(_reports(spark, sf_dir).drop("mda_ord"), _links(spark, sf_dir))


@query(f"""WITH {_PAIR}, n AS (SELECT ticker, year(publish_date)::INTEGER AS report_year, count(DISTINCT news_document_id) AS num_news FROM news GROUP BY 1, 2),
l AS (SELECT mda_document_id, count(*) FILTER (relation_type IN ('strong_support', 'contextual_support', 'partial_support') AND source_independence IN ('medium', 'high')) AS s, sum(contradiction_flag) AS c FROM links GROUP BY 1)
SELECT p.ticker, p.report_year, p.mda_document_id, coalesce(num_news, 0)::BIGINT AS num_news, coalesce(s, 0)::BIGINT AS independent_support_count, coalesce(c, 0)::BIGINT AS contradiction_count, cross_validation_score FROM pairs p LEFT JOIN n ON n.ticker = p.ticker AND n.report_year = p.report_year LEFT JOIN l ON l.mda_document_id = p.mda_document_id""")
def company_year_links(spark, sf_dir):
    links = _links(spark, sf_dir)
    pairs = X.pair_summary(_reports(spark, sf_dir).drop("mda_ord"), links).select("mda_document_id", "ticker", "report_year", "cross_validation_score")
    support = F.count_if(F.col("relation_type").isin("strong_support", "contextual_support", "partial_support") & F.col("source_independence").isin("medium", "high"))
    by = links.groupBy("mda_document_id").agg(support.alias("independent_support_count"), F.sum("contradiction_flag").alias("contradiction_count"))
    n = _news(spark, sf_dir).groupBy("ticker", F.year("publish_date").alias("report_year")).agg(F.count_distinct("news_document_id").alias("num_news"))
    out = pairs.join(n, ["ticker", "report_year"], "left").join(by, "mda_document_id", "left")
    return out.fillna(0, ["num_news", "independent_support_count", "contradiction_count"]).select("ticker", "report_year", "mda_document_id", "num_news", "independent_support_count", "contradiction_count", "cross_validation_score")


@query(f"WITH {_REL}, b AS (SELECT mda_document_id, sum(contradiction_flag) AS c, count(*) AS n FROM links GROUP BY 1) SELECT coalesce(sum(c), 0)::BIGINT AS contradictions, coalesce(sum(n), 0)::BIGINT AS links, (sum(c) >= 3 AND sum(c)::DOUBLE / greatest(sum(n), 1) > 0.2) OR max(c) >= 3 AS systemic_conflict FROM b")
def systemic_conflict(spark, sf_dir):
    return X.systemic_conflict(_links(spark, sf_dir))


@query(f"WITH {_REL} SELECT relation_type, support_level, count(*) AS n FROM links GROUP BY 1, 2")
def relation_counts(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("relation_type", "support_level").agg(F.count("*").alias("n"))


_YEARS = "y AS (SELECT o_custkey AS code, year(o_orderdate)::INTEGER AS year, round(sum(o_totalprice), 2) AS assets FROM orders GROUP BY 1, 2)"


def _years(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("code"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("assets"))


@query(f"WITH {_YEARS}, l AS (SELECT *, lag(assets) OVER (PARTITION BY code ORDER BY year) AS prev FROM y) SELECT code, year, round(assets / prev, 6) AS ratio FROM l WHERE prev > 0 AND abs(assets / prev - 1) > 0.5")
def yoy_swings(spark, sf_dir):
    w = Window.partitionBy("code").orderBy("year")
    l = _years(spark, sf_dir).withColumn("prev", F.lag("assets").over(w))
    return l.where((F.col("prev") > 0) & (F.abs(F.col("assets") / F.col("prev") - 1) > 0.5)).select("code", "year", F.round(F.col("assets") / F.col("prev"), 6).alias("ratio"))


@query(f"WITH {_YEARS}, h AS (SELECT code, year, CASE WHEN (code + year) % 3 <> 0 THEN assets END AS assets, assets + 1 AS comparative FROM y) SELECT h.code, h.year, coalesce(h.assets, n.comparative) AS assets, CASE WHEN h.assets IS NULL AND n.comparative IS NOT NULL THEN 'next_year' WHEN h.assets IS NULL THEN 'missing' ELSE 'own' END AS filled_from FROM h LEFT JOIN h n ON n.code = h.code AND n.year = h.year + 1")
def next_year_fill(spark, sf_dir):
    from scorewright.operators.fundamentals import filled_from_next_year

    h = _years(spark, sf_dir).select("code", "year", F.when((F.col("code") + F.col("year")) % 3 != 0, F.col("assets")).alias("assets"), (F.col("assets") + 1).alias("comparative"))
    return filled_from_next_year(h, "code", "year", "assets", "comparative")


_FREEZE = f"""{SQL_COMPANIES}, e AS (SELECT document_id, bool_or(dimension_code = 'D2' AND raw_score = 1) AS numeric_conflict, bool_or(raw_score = 5 AND document_id % 4 = 0) AS missing_evidence, count(*) < 3 AS too_few FROM ratings GROUP BY 1),
x AS (SELECT document_id, concat_ws(';', CASE WHEN missing_evidence THEN 'missing_evidence' END, CASE WHEN numeric_conflict THEN 'numeric_conflict' END) AS reasons FROM e)"""


def _freeze(spark, sf_dir):
    r = R.ratings(spark, sf_dir)
    return G.exclusions(r, "document_id", {"missing_evidence": (F.col("raw_score") == 5) & (F.col("document_id") % 4 == 0), "numeric_conflict": (F.col("dimension_code") == "D2") & (F.col("raw_score") == 1)})


@query(f"WITH {_FREEZE} SELECT document_id, reasons <> '' AS excluded, reasons FROM x")
def freeze_exclusions(spark, sf_dir):
    return _freeze(spark, sf_dir)


@query(f"WITH {_FREEZE}, d AS (SELECT unnest(['missing_evidence', 'numeric_conflict', 'schema_invalid']) AS reason) SELECT reason, count(x.document_id) AS n FROM d LEFT JOIN x ON list_contains(string_split(reasons, ';'), reason) GROUP BY reason")
def exclusion_distribution(spark, sf_dir):
    return G.reason_distribution(_freeze(spark, sf_dir), "reasons", ["missing_evidence", "numeric_conflict", "schema_invalid"])


_GATES = [("complete_share", "min", 0.03), ("exclusion_rate", "max", 0.30), ("evidence_rate", "min", 0.95)]
_MEASURES = f"{_FREEZE}, m AS (SELECT round((SELECT count(*) FROM complete)::DOUBLE / count(*), 6) AS complete_share, round(avg((reasons <> '')::INTEGER), 6) AS exclusion_rate, round(avg((NOT contains(reasons, 'missing_evidence'))::INTEGER), 6) AS evidence_rate FROM x), g AS (" + " UNION ALL ".join(f"SELECT '{n}' AS metric, {n} AS value, {t}::DOUBLE AS threshold, {n} {'>=' if k == 'min' else '<='} {t} AS passed FROM m" for n, k, t in _GATES) + ")"


def _gates(spark, sf_dir):
    from scorewright.operators.scoring import complete

    wide = R.wide(spark, sf_dir)
    share = complete(wide, CODES).agg(F.count("*").alias("c"))
    m = _freeze(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(F.col("excluded").cast("int")), 6).alias("exclusion_rate"), F.round(F.avg((~F.contains("reasons", F.lit("missing_evidence"))).cast("int")), 6).alias("evidence_rate"))
    both = m.join(F.broadcast(share), F.lit(True)).withColumn("complete_share", F.round(F.col("c") / F.col("n"), 6))
    return G.quality_gates(both, _GATES)


@query(f"WITH {_MEASURES} SELECT * FROM g")
def quality_gates(spark, sf_dir):
    return _gates(spark, sf_dir)


@query(f"WITH {_MEASURES} SELECT bool_and(passed) AS passed, list_sort(coalesce(list(metric) FILTER (NOT passed), []::VARCHAR[])) AS blockers FROM g")
def freeze_decision(spark, sf_dir):
    return G.all_passed(_gates(spark, sf_dir), [n for n, _, _ in _GATES])


@query("SELECT event_type, round(avg((value > 10)::INTEGER), 6) AS parse_rate, round(avg((value > 1)::INTEGER), 6) AS schema_rate, array_to_string(list_filter([CASE WHEN avg((value > 10)::INTEGER) < 0.5 THEN 'parse_rate' END, CASE WHEN avg((value > 1)::INTEGER) < 0.9 THEN 'schema_rate' END], lambda v: v IS NOT NULL), ';') AS violations FROM events GROUP BY event_type")
def threshold_monitor(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a, b = F.avg((F.col("value") > 10).cast("int")), F.avg((F.col("value") > 1).cast("int"))
    return e.groupBy("event_type").agg(F.round(a, 6).alias("parse_rate"), F.round(b, 6).alias("schema_rate"), F.array_join(F.array_compact(F.array(F.when(a < 0.5, "parse_rate"), F.when(b < 0.9, "schema_rate"))), ";").alias("violations"))


@query("SELECT s_suppkey, s_name, coalesce(n_name, 'unknown') AS nation, coalesce(r_name, 'unknown') AS region, CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0.0::DOUBLE END AS balance FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def registry_lookup(spark, sf_dir):
    """Small lookups with defaults for what is missing; the join strategy follows their size."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return j.select("s_suppkey", "s_name", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("r_name", F.lit("unknown")).alias("region"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).otherwise(0.0).alias("balance"))


@query(f"""WITH {SQL_WIDE}, o AS (SELECT DISTINCT o_custkey AS t, year(o_orderdate) AS y FROM orders), e AS (SELECT DISTINCT user_id AS t, 1995 + event_id % 8 AS y FROM events)
SELECT (SELECT count(*) FROM o) AS report_years, (SELECT count(*) FROM e) AS news_years, (SELECT count(*) FROM (SELECT t, y FROM o INTERSECT SELECT t, y FROM e)) AS shared_years""")
def company_year_overlap(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("t"), F.year("o_orderdate").cast("long").alias("y")).distinct()
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("t"), (1995 + F.col("event_id") % 8).alias("y")).distinct()
    both = o.withColumn("o_", F.lit(1)).join(e.withColumn("e_", F.lit(1)), ["t", "y"], "full")
    return both.agg(F.count("o_").alias("report_years"), F.count("e_").alias("news_years"), F.count(F.when(F.col("o_").isNotNull() & F.col("e_").isNotNull(), 1)).alias("shared_years"))
