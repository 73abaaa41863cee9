"""Queries on registries, audits, cleaning and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.operators import claims as C
from scorewright.operators import documents as D
from scorewright.operators import registry as G
from scorewright.plans import ratings as R
from scorewright.plans.ratings import CODES, SQL_RATINGS, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey, o_custkey FROM orders WHERE lower(trim(CASE o_orderstatus WHEN 'F' THEN ' Yes ' WHEN 'O' THEN 'No' ELSE 'Manual' END)) = 'yes' AND o_orderpriority <> '5-LOW'")
def include_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("include_flag", F.when(F.col("o_orderstatus") == "F", " Yes ").when(F.col("o_orderstatus") == "O", "No").otherwise("Manual"))
    o = o.withColumn("synthetic_flag", F.when(F.col("o_orderpriority") == "5-LOW", "TRUE").otherwise("0")).withColumn("notes", F.lit(None).cast("string"))
    return G.real_rows(G.included(o)).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25")
def pilot_limit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("include_flag", F.when(F.col("o_orderstatus") == "F", "y").otherwise("no"))
    return G.included(o, lenient=True, limit=25, order="o_orderkey").select("o_orderkey")


@query("SELECT event_id, event_type IN ('error', 'signup') OR value > 90 AS violation FROM events")
def scope_violations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    reasons = F.when(F.col("event_type") == "error", "late| Out_Of_Scope ").otherwise("late;minor")
    status = F.when(F.col("event_type") == "signup", "unusable_url_only").otherwise("ok")
    return e.select("event_id", G.scope_violation((F.col("value") > 90).cast("string"), reasons, status).alias("violation"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'confirmed_numeric_failure' WHEN 'signup' THEN 'numeric_review_required' WHEN 'view' THEN 'not_enough_numbers' ELSE 'no_numeric_issue' END AS status FROM events""")
def numeric_status_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    note = F.when(F.col("event_type") == "error", "Numeric failure in table").when(F.col("event_type") == "signup", "needs numeric review").when(F.col("event_type") == "view", "Not enough numbers").otherwise(None)
    return e.select("event_id", G.numeric_status(note, F.lit("x")).alias("status"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN 'parser_false_positive/unit_mismatch' WHEN l_quantity < 0 THEN '' WHEN l_returnflag = 'R' THEN 'needs_manual_review/profit_loss_swing' WHEN abs(l_tax * 100 - l_discount * 100) <= 3 THEN 'parser_false_positive/rounding' ELSE 'real_discrepancy/true_math_error' END AS triage FROM lineitem""")
def discrepancy_triage(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    early = F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")
    source = F.when(early, "revenue of RM5 million").when(F.col("l_returnflag") == "R", "profit to loss").otherwise("sales")
    t = G.discrepancy_triage(F.lit("sales"), source, F.lit(""), F.col("l_quantity"), F.when(early, 900.0).otherwise(F.col("l_tax") * 100), F.col("l_discount") * 100)
    return l.select("l_orderkey", "l_linenumber", t.alias("t")).select("l_orderkey", "l_linenumber", F.concat("t.label", F.lit("/"), "t.reason").alias("triage"))


@query("""WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), h AS (SELECT doc_id, t, contains(t, 'risk')::INTEGER + contains(t, 'market')::INTEGER + contains(t, 'sen')::INTEGER AS z, """ + " + ".join(f"contains(t, '{w}')::INTEGER" for w in G.EVIDENCE_WORDS["AR04"]) + """ AS hits FROM x)
SELECT doc_id, CASE WHEN trim(t) = '' THEN 'not_checkable' WHEN hits = 0 THEN 'weak' WHEN hits >= 2 THEN 'strong' ELSE 'acceptable' END AS status, CASE WHEN trim(t) = '' THEN 'evidence_not_in_text' WHEN hits = 0 THEN 'missing_risk_or_outlook' ELSE 'none' END AS issue FROM h""")
def evidence_semantics(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", G.evidence_class(F.lit("AR04"), F.col("text"), F.lit("")).alias("c")).select("doc_id", "c.status", "c.issue")


#: Evidence that quotes nothing, page furniture, or words of one dimension or another.
QUOTES = ("", "Registered office and proxy form", "The outlook holds risk and uncertain prospects", "Sales rose because of export demand", "Numeric values were not calculable", "Nothing to report here", "It went up by 12 %", "A summary table of each segment and its market")
_CODES = list(G.EVIDENCE_WORDS)
_CASES_SQL = "q AS (SELECT unnest(range(0, {0})) AS k, lower(unnest({1})) AS t), c AS (SELECT k, t, c FROM q, (SELECT unnest({2}) AS c))".format(len(QUOTES), list(QUOTES), _CODES)
_HITS_SQL = "CASE c " + " ".join(f"WHEN '{c}' THEN " + " + ".join(f"contains(t, '{w}')::INTEGER" for w in words) for c, words in G.EVIDENCE_WORDS.items()) + " END"
_MISSING_SQL = " ".join(f"WHEN c = '{c}' AND hits = 0 THEN ['weak', '{i}', 'partial', 'manual_review']" for c, i in G.MISSING_ISSUE.items())


@query(f"""WITH {_CASES_SQL}, h AS (SELECT *, {_HITS_SQL} AS hits FROM c),
r AS (SELECT k, c, CASE WHEN t = '' THEN ['not_checkable', 'evidence_not_in_text', 'not_checkable', 'check_text_cleaning'] WHEN regexp_matches(t, '{"|".join(G.NOISE)}') THEN ['invalid', 'non_mda_noise', 'misaligned', 'check_text_cleaning']
  WHEN c = 'AR02' AND hits = 0 AND NOT regexp_matches(t, '[0-9]+(\\.[0-9]+)?\\s*(%|million|sen|rm)') THEN ['invalid', 'missing_financial_content', 'misaligned', 'rerun_dimension_only'] WHEN c = 'AR02' AND regexp_matches(t, 'numeric|not calculable') THEN ['acceptable', 'numeric_review_required', 'partial', 'manual_review']
  {_MISSING_SQL} WHEN hits >= 2 THEN ['strong', 'none', 'aligned', 'accept'] ELSE ['acceptable', 'none', 'aligned', 'accept'] END AS r FROM h)
SELECT o_orderkey, r[1] AS status, r[2] AS issue, r[3] AS alignment, r[4] AS action FROM orders JOIN r ON k = o_orderkey % {len(QUOTES)} AND c = list_extract({_CODES}, (o_custkey % {len(_CODES)} + 1)::BIGINT)""")
def order_evidence_semantics(spark, sf_dir):
    """A dimension and a piece of evidence for each order: what the evidence is worth for the dimension. All classes occur."""
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", G.evidence_class(pick(_CODES, F.col("o_custkey")), pick(QUOTES, F.col("o_orderkey")), F.lit("")).alias("c")).select("o_orderkey", "c.*")


@query("""SELECT stage, action, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'ollama_timeout' WHEN event_type = 'click' THEN 'json_parse' WHEN value < 5 THEN 'text_quality' WHEN event_type = 'view' THEN 'numeric_check' ELSE 'unknown' END AS stage,
CASE WHEN event_type = 'error' THEN 'reduce_context_and_retry' WHEN event_type = 'click' THEN 'repair_json_and_retry' WHEN value < 5 THEN 'reduce_context_and_retry' WHEN event_type = 'view' THEN 'numeric_checker_review' ELSE 'manual_review' END AS action FROM events) GROUP BY 1, 2""")
def failure_stages(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    is_ = lambda x: F.col("event_type") == x
    s = G.failure_stage(F.when(is_("error"), "Timeout at 3").otherwise(""), F.when(is_("click"), "parse_failed").otherwise("ok"), F.lit("valid"), F.when(F.col("value") < 5, 10).otherwise(200), F.lit("valid"), F.lit("ok"), F.when(is_("view"), 2).otherwise(0))
    return e.select(s.alias("s")).groupBy("s.stage", "s.action").agg(F.count("*").alias("n"))


@query(f"""WITH {SQL_RATINGS}, i AS (SELECT document_id, unnest(list_filter([CASE WHEN dimension_code NOT IN ('D1', 'D2', 'D3', 'D4') THEN 'unexpected_dimension' END, CASE WHEN raw_score > 4 THEN 'raw_score_out_of_range' END], lambda x: x IS NOT NULL)) AS issue FROM ratings) SELECT issue, count(*) AS n, count(DISTINCT document_id) AS documents FROM i GROUP BY issue""")
def rating_violations(spark, sf_dir):
    r = R.ratings(spark, sf_dir)
    v = G.violations(r, "document_id", {"unexpected_dimension": ~F.col("dimension_code").isin("D1", "D2", "D3", "D4"), "raw_score_out_of_range": F.col("raw_score") > 4})
    return v.groupBy("issue").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("documents"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return G.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT doc_id, length(text)::INTEGER AS original_chars, least(length(text), 11500)::INTEGER AS kept_chars, greatest(0, length(text) - 11500)::INTEGER AS lost_chars, round(greatest(0, length(text) - 11500)::DOUBLE / greatest(length(text), 1), 6) AS lost_share FROM documents")
def context_truncation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", G.truncation(F.col("text")).alias("t")).select("doc_id", "t.*")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'default' ELSE o_orderpriority END AS model_name FROM orders")
def backfill_defaults(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "  ").otherwise(F.col("o_orderpriority")).alias("model_name"))
    return G.filled(o, {"model_name": "default"})


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def available_flag_choice(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("No").alias("broad"), F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No").alias("main"))
    return G.by_available_flag(o, "broad", "main").select("o_orderkey")


@query(f"WITH {SQL_RATINGS} SELECT o.o_orderkey AS document_id, c.code AS dimension_code FROM orders o CROSS JOIN (VALUES ('D1'), ('D2'), ('D3'), ('D4'), ('D5')) c(code) WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.document_id = o.o_orderkey AND r.dimension_code = c.code)")
def resume_tasks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"))
    return G.tasks(o, CODES, R.ratings(spark, sf_dir))


@query("SELECT o_orderkey AS document_id, CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderpriority END AS note, c_name AS company FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def registry_overlay(spark, sf_dir):
    """Score rows over registry rows: blanks of the score rows stand."""
    o = table(spark, sf_dir, "orders")
    base = o.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("o_orderkey").alias("document_id"), F.lit("registry").alias("note"), F.col("c_name").alias("company"))
    over = o.select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderpriority")).alias("note"))
    return G.overlaid(base, over, "document_id")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN c_mktsegment WHEN c_acctbal > 0 THEN 'second' ELSE '' END AS segment FROM customer")
def first_filled_metadata(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = c.select("c_custkey", F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).otherwise(" ").alias("segment"))
    b = c.where("c_acctbal > 0").select("c_custkey", F.lit("second").alias("segment"))
    return G.first_filled(c.select("c_custkey"), [a, b], "c_custkey", ["segment"])


@query("""WITH t AS (SELECT l_partkey AS p, l_suppkey AS s, l_orderkey AS k FROM lineitem), r AS (SELECT DISTINCT o_custkey AS p, o_custkey % 7 AS s FROM orders),
m AS (SELECT r.p, r.s, t.k, row_number() OVER (PARTITION BY r.p, r.s ORDER BY (t.s <> r.s)::INTEGER, t.k) AS n FROM r JOIN t ON t.p = r.p) SELECT r.p, r.s, m.k FROM r LEFT JOIN m ON m.p = r.p AND m.s = r.s AND m.n = 1""")
def two_pass_lookup(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_orderkey").alias("k"), F.col("l_orderkey").alias("o"))
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("p"), (F.col("o_custkey") % 7).alias("s")).distinct()
    return G.two_pass_lookup(r, t, ["p"], "s", "o", "k")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS broad, c_mktsegment = 'BUILDING' AS strict FROM customer")
def sample_flags(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    members = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    a = G.membership(c, members, "c_custkey", F.lit(False), "broad")
    return G.membership(a, members.where("1 = 0"), "c_custkey", F.col("c_mktsegment") == "BUILDING", "strict").select("c_custkey", "broad", "strict")


@query("SELECT event_type, count(*) AS records, count(*) FILTER (value > 10) AS succeeded FROM events GROUP BY 1")
def batch_success(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("records"), F.count_if(F.col("value") > 10).alias("succeeded"))


@query("SELECT event_id, TRY_CAST(props ->> '$.k' AS DOUBLE) AS k FROM events")
def tolerant_numbers(spark, sf_dir):
    from scorewright.functions.numbers import number_or

    return table(spark, sf_dir, "events").select("event_id", number_or(F.get_json_object("props", "$.k"), -1.0).alias("k"))


@query("""SELECT doc_id, 3 AS N01, CASE WHEN regexp_matches(lower(text), 'source|according to') THEN 4 ELSE 2 END AS N02, CASE WHEN regexp_matches(lower(text), 'shocking|must buy') THEN 2 ELSE 3 END AS N03, 3 AS N04, CASE WHEN contains(lower(text), 'shocking') THEN 2 ELSE 3 END AS N05 FROM documents""")
def rule_document_scores(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", D.rule_document_scores(F.col("text"), "news").alias("s")).select("doc_id", "s.*")


@query(r"""WITH x AS (SELECT page_id, trim(regexp_replace(url, '\s+', ' ', 'g')) AS u FROM pages) SELECT page_id, rtrim(left(u, 40)) AS short_url, regexp_matches(trim(u), '^https?://\S+$') OR contains(lower(u), 'lorem ipsum') AS is_placeholder FROM x""")
def placeholder_flags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", D.shortened(F.col("url"), 40).alias("short_url"), D.placeholder(F.col("url"), F.lit(""), F.lit("")).alias("is_placeholder"))


@query("""SELECT doc_id, list_filter([CASE WHEN trim(text) = '' THEN 'missing_article_text' END, CASE WHEN length(regexp_replace(text, '\\s+', '', 'g')) < 200 THEN 'short_article_text' END, CASE WHEN doc_id % 11 = 0 THEN 'invalid_publish_date' END], lambda x: x IS NOT NULL) AS reasons FROM documents""")
def ingest_reasons(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    date = F.when(F.col("doc_id") % 11 != 0, F.lit("2024-01-01"))
    return d.select("doc_id", D.ingest_reasons(F.col("text"), F.lit(""), F.lit(""), date, F.lit(False)).alias("reasons"))


@query(None)
def report_paragraphs(spark, sf_dir):
    return D.cleaned(table(spark, sf_dir, "documents"), id_col="doc_id").withColumnRenamed("document_id", "doc_id")


@query(None)
def article_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", D.article_paragraphs(F.substring("text", 1, 40), F.col("text")).alias("article"))


@query(None)
def link_claims_extracted(spark, sf_dir):
    from scorewright.plans.texts import news, reports

    return C.link_claims_of(reports(spark, sf_dir), "mda").unionByName(C.link_claims_of(news(spark, sf_dir), "news"))
