"""Queries on texts, payloads and files that are written out of the tables, so that what they should yield follows from the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scorewright.functions import text as X
from scorewright.operators import claims as C
from scorewright.operators import documents as D
from scorewright.operators import fundamentals as B
from scorewright.operators import numeric as N
from scorewright.operators import samples as M
from scorewright.plans import statements as S
from scorewright.plans.ratings import table
from scorewright.plans.texts import _TOKENS_SQL
from scorewright.sources import readers, sheets, sinks
from scorewright.sources.tables import keeper, shared_folder, spread

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pick(values: list, i):
    return F.element_at(F.array(*[F.lit(v) if isinstance(v, str | int) else v for v in values]), (i % len(values) + 1).cast("int"))


def _sql_pick(values: list, i: str) -> str:
    return f"list_extract({values}, (({i}) % {len(values)} + 1)::BIGINT)"


@query(f"""WITH p AS (SELECT conv_id, turn, 'Score one dimension.' || chr(10) || 'Be strict. Example: {{}}' || chr(10) || 'METADATA:' || chr(10) || '{{"conv_id":' || conv_id || ',"turn":' || turn || '}}' || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || text AS p FROM conversations)
SELECT conv_id, turn, {_TOKENS_SQL.format(t='p')} AS prompt_tokens, length(p)::INTEGER AS prompt_chars FROM p""")
def scoring_prompts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    p = D.prompt(F.lit("Score one dimension.\nExample: {}"), F.struct("conv_id", "turn"), F.col("text"), tone="Be strict. ")
    return c.select("conv_id", "turn", X.token_estimate(p).alias("prompt_tokens"), F.char_length(p).alias("prompt_chars"))


#: Claims that differ in what the rules look at.
CLAIM_TYPES = ["financial_claim", "causal_claim", "risk_claim", "strategy_claim", "market_claim", "outlook_claim", "event_claim"]


@query(f"""WITH c AS (SELECT o_orderkey, {_sql_pick(CLAIM_TYPES, 'o_orderkey')} AS t, o_custkey % 2 = 0 AS located, o_custkey % 3 AS sure, o_orderkey % 4 AS v FROM orders)
SELECT o_orderkey, greatest(1, least(5, 3 + located::INTEGER + CASE sure WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END + CASE WHEN t = 'financial_claim' AND v = 3 OR t IN ('causal_claim', 'market_claim') AND v >= 2 OR t IN ('risk_claim', 'outlook_claim') THEN 1 ELSE 0 END))::INTEGER AS score FROM c""")
def claim_rule_score_cases(spark, sf_dir):
    """A claim for each order: its type, locator, confidence, value, direction and words follow from the order's numbers."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    claims = table(spark, sf_dir, "orders").select("o_orderkey", _pick(CLAIM_TYPES, k).alias("claim_type"), F.when(c % 2 == 0, "[MDA_P001]").otherwise("").alias("evidence_locator"), _pick(["high", "low", "medium"], c).alias("confidence"), F.when(k % 4 == 3, "5%").otherwise("").alias("value"), _pick(["increase", "neutral", "decrease", "decrease"], k).alias("direction"), F.when(k % 4 >= 2, " three whole words ").otherwise("two words").alias("claim_text"))
    return claims.select("o_orderkey", C.rule_score(claims).alias("score"))


@query(f"""WITH o AS (SELECT o_orderkey::VARCHAR AS document_id, o_orderkey % 5 AS kind, o_orderkey % 2 = 0 AS up FROM orders),
c AS (SELECT document_id, 1 AS n, CASE WHEN kind < 3 THEN 'profit' ELSE 'revenue' END AS topic, CASE WHEN kind >= 3 THEN 'unknown' WHEN up THEN 'increased' ELSE 'decreased' END AS direction, 'financial_result' AS claim_type FROM o
UNION ALL SELECT document_id, 2, CASE kind WHEN 0 THEN 'raw_material' ELSE 'capacity_expansion' END, 'increased', CASE kind WHEN 0 THEN 'cost_pressure' ELSE 'expansion' END FROM o WHERE kind IN (0, 4))
SELECT document_id || '_C' || lpad(row_number() OVER (PARTITION BY document_id ORDER BY n)::VARCHAR, 3, '0') AS claim_id, document_id, claim_type, topic, direction, 'S' || lpad(n::VARCHAR, 3, '0') AS evidence_locator FROM c""")
def order_link_claims(spark, sf_dir):
    """Claims for linking in every order's statement: at most one a sentence."""
    return C.link_claims_of(S.statements(spark, sf_dir), "mda").select("claim_id", "document_id", "claim_type", "topic", "direction", "evidence_locator")


def reports(spark, sf_dir):
    """A report for each customer: running headers, page numbers, split words, sections, and repeats."""
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    top = F.when(F.col("c_custkey") % 3 == 0, "FINANCIAL REVIEW\n").when(F.col("c_custkey") % 3 == 1, "").otherwise("Business overview\n")
    body = F.concat(F.lit("ANNUAL REPORT 1998\r\n12\n"), top, F.lit("The busi-\nness "), k, F.lit(" did well.\n\nSame "), n, F.lit(".\n\n\nSame "), n, F.lit(".\n7\n\nRevenue RM"), n, F.lit(".\n\nRevenue  RM"), n, F.lit(".\n\nOutlook\nBright\x07 days.\n\n \n"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), body.alias("text"))


@query("""WITH c AS (SELECT c_custkey AS document_id, CASE c_custkey % 3 WHEN 0 THEN 'financial review' WHEN 1 THEN 'Unknown' ELSE 'overview' END AS top, c_nationkey AS n FROM customer),
p AS (SELECT document_id, unnest([1, 2, 3, 4, 5]) AS k, unnest([top, top, top, top, 'outlook']) AS section, unnest(['The business ' || document_id || ' did well.', 'Same ' || n || '.', 'Revenue RM' || n || '.', 'Revenue RM' || n || '.', 'Bright days.']) AS text FROM c)
SELECT document_id, 'MDA_P' || lpad(k::VARCHAR, 3, '0') AS paragraph, section, text FROM p""")
def customer_report_paragraphs(spark, sf_dir):
    """Paragraphs of every customer's report, cleaned, numbered and put in sections."""
    return D.cleaned(reports(spark, sf_dir))


@query("""WITH c AS (SELECT c_custkey, c_custkey % 7 + 1 AS n, c_custkey % 2 = 0 AS cut FROM customer), s AS (SELECT c_custkey, cut, n, list_transform(range(1, n + 1), lambda i: repeat(chr((96 + i)::INTEGER), 199) || '.') AS l FROM c),
g AS (SELECT c_custkey, cut AND n > 1 AS apart, l, n FROM s),
p AS (SELECT c_custkey, CASE WHEN apart THEN l ELSE list_transform(range(0, ceil(n / 3.0)::BIGINT), lambda j: array_to_string(l[3 * j + 1 : 3 * j + 3], ' ')) END AS ps FROM g)
SELECT c_custkey, '[TITLE]' || chr(10) || 'Title ' || c_custkey || chr(10) || chr(10) || array_to_string(list_transform(range(1, len(ps) + 1), lambda i: '[NEWS_P' || lpad(i::VARCHAR, 3, '0') || '] ' || ps[i]), chr(10) || chr(10)) || chr(10) AS article FROM p""")
def customer_articles(spark, sf_dir):
    """Located text of an article of each customer: paragraphs where blank lines part them, else sentences packed to 450 characters."""
    n = (F.col("c_custkey") % 7 + 1).cast("int")
    sentences = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.repeat(F.char(F.lit(96) + i), F.lit(199)), F.lit(".")))
    text = F.when(F.col("c_custkey") % 2 == 0, F.array_join(sentences, "\n \n\n")).otherwise(F.array_join(sentences, "  "))
    c = spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", F.concat(F.lit(" Title  "), F.col("c_custkey").cast("string")).alias("title"), text.alias("text"))
    return D.articles(c, "title", "text").select("c_custkey", "article")


_DIMENSIONS = ["AR01", "AR02", "AR03", "AR04", "AR05"]


@query("""SELECT o_orderkey, array_to_string(list_sort(list_filter([CASE WHEN o_orderkey % 11 = 0 THEN 'json_parse_failed' END, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 2 = 0 THEN 'missing_top_field_needs_review' END, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 3 = 0 THEN 'invalid_doc_type' END, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 5 = 0 THEN 'raw_score_out_of_range' END,
CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 = 0 THEN 'dimension_codes_not_expected_order' END, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 = 0 THEN 'dimension_count_not_5' END, CASE WHEN o_orderkey % 11 <> 0 AND o_custkey % 2 = 0 THEN 'invalid_flag_uncertain' END, CASE WHEN o_orderkey % 11 <> 0 AND o_custkey % 3 = 0 THEN 'empty_evidence_locator' END,
CASE WHEN o_orderkey % 11 <> 0 AND o_custkey % 5 = 0 THEN 'invalid_confidence_level' END, CASE WHEN o_orderkey % 11 <> 0 AND o_custkey % 7 = 0 THEN 'scope_violation' END], lambda x: x IS NOT NULL)), ';') AS issues FROM orders""")
def full_payload_issue_lists(spark, sf_dir):
    """Issues of complete payloads written out of the orders, with every kind of defect."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    one = lambda code, first: F.concat(F.lit(f'{{"dimension_code": "{code}", "raw_score": '), F.when((k % 5 == 0) & F.lit(first), "9").otherwise("3"), F.lit(', "reason": "r", "evidence_locator": "'), F.when((c % 3 == 0) & F.lit(first), "").otherwise("[MDA_P001]"), F.lit('", "confidence_level": "'), F.when((c % 5 == 0) & F.lit(first), "sure").otherwise("high"), F.lit('"}'))
    dims = F.concat_ws(", ", *[F.when((k % 7 != 0) | F.lit(code != "AR03"), one(code, code == "AR01")) for code in _DIMENSIONS])
    comment = F.when(c % 7 == 0, "This matches the audited financial statements").otherwise("fine")
    payload = F.concat(F.lit('{"document_id": "d", "doc_type": "'), F.when(k % 3 == 0, "blog").otherwise("mda"), F.lit('", "scoring_basis": "b", "scorebook_version": "1", "evidence_limitation": "", "dimension_scores": ['), dims, F.lit('], "flags": {"uncertain": '), F.when(c % 2 == 0, "2").otherwise("1"), F.lit('}, "overall_comment": "'), comment, F.lit('", '), F.when(k % 2 == 0, "").otherwise('"needs_review": false, '), F.lit('"review_reasons": []'), F.when(k % 11 == 0, "").otherwise("}"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(D.full_payload_issues(payload, _DIMENSIONS, ["uncertain"]), ";").alias("issues"))


@query(f"WITH {S._CHECKS_SQL}, b AS (SELECT (document_id::BIGINT % 300)::VARCHAR AS book, document_id, status FROM k WHERE status IN ('material_discrepancy', 'severe_direction_conflict')), n AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY document_id) AS nth FROM b) SELECT book, document_id, status FROM n WHERE nth <= 4")
def compact_checks(spark, sf_dir):
    """Of the checks of three hundred books of statements, the first four of each that went wrong."""
    checks = N.numeric_checks(S.statements(spark, sf_dir)).withColumns({"book": (F.col("document_id").cast("long") % 300).cast("string"), "evidence_locator": F.col("document_id")})
    return D.compact_by_group(checks, "book", ["document_id", "status", "source_text"], 4).select("book", F.col("c.evidence_locator").alias("document_id"), "c.status")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE rtrim(substring(trim(regexp_replace('about ' || role || '  ' || turn, '\\s+', ' ', 'g')), 1, 14)) END AS quoted FROM conversations")
def locator_lookup(spark, sf_dir):
    """The text at a locator, one-spaced and shortened; empty where the text has no such locator."""
    turn = F.format_string("[MDA_P%03d]", (F.col("turn") % 500).cast("int"))
    text = F.concat(F.lit("[TITLE] a title\n"), turn, F.lit("\nabout "), "role", F.lit("  "), F.col("turn").cast("string"), F.lit("\n[NEWS_P001] rest"))
    asked = F.when(F.col("turn") % 3 == 2, "[MDA_P999]").when(F.col("turn") % 3 == 1, F.regexp_replace(turn, r"[\[\]]", "")).otherwise(turn)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.located_text(text, asked, 14).alias("quoted"))


@query("""WITH p AS (SELECT c_custkey, c_custkey % 4 AS k, round(c_acctbal, 2) AS v FROM customer)
SELECT c_custkey::VARCHAR AS document_id, CASE WHEN k = 3 THEN -abs(v) ELSE abs(v) END AS value, CASE WHEN k = 2 THEN 2 ELSE 1 END AS page FROM p""")
def statement_figures(spark, sf_dir):
    """The figure after a label on the pages of each customer's statement: on its line, on the next, on a later page, or in brackets."""
    v, k = F.format_string("%.2f", F.abs("c_acctbal")), F.col("c_custkey") % 4
    line = F.when(k == 0, F.concat(F.lit("Total Assets 1998 "), v)).when(k == 1, F.concat(F.lit("TOTAL ASSETS\n"), v)).when(k == 2, F.concat(F.lit("Total assets\nnone\n\fNote\ntotal assets: "), v, F.lit(" 7"))).otherwise(F.concat(F.lit("total assets ("), v, F.lit(")")))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("document_id"), F.concat(F.lit("Contents\n\f"), line, F.lit("\nend")).alias("text"))
    return B.labelled_figure(B.pages(docs), "total assets")


@query("SELECT 'line' || k AS key, k % 3 = 0 AS twice FROM (SELECT DISTINCT o_custkey AS k FROM orders)")
def picks_in_order(spark, sf_dir):
    """Rows of two picks, each key once and from the first that has it; keys of both are told by their list of picks, in order and each once."""
    k = table(spark, sf_dir, "orders").select(F.concat(F.lit("line"), F.col("o_custkey").cast("string")).alias("key"), (F.col("o_custkey") % 3 == 0).alias("rule")).distinct()
    both = M.union_first([k.where("rule").withColumn("pick", F.lit("rule")), k.withColumn("pick", F.lit("all"))], "key")
    lists = k.select("key", F.array_distinct(F.array_compact(F.array(F.when(F.col("rule"), "rule"), F.lit("all"), F.when(F.col("rule"), "rule")))).alias("l"))
    return both.select("key", "pick").join(lists, "key").where(F.col("pick") == F.col("l")[0]).select("key", (F.size("l") == 2).alias("twice"))


@query(None)
def seeded_sample(spark, sf_dir):
    """Twenty documents at the places of a seeded draw, and the longest text of each source, each document once. The draw is that of Python's generator, which SQL has not; a test repeats it."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.char_length("text").alias("n"))
    from scorewright.operators.scan import numbered

    placed = numbered(d, [], ["doc_id"], "place_")
    picks = M.seeded_picks(placed.count(), 20)
    drawn = placed.where(F.col("place_").isin([p + 1 for p in picks])).select("doc_id", F.lit("random").alias("pick"))
    ruled = d.groupBy("source").agg(F.max(F.struct("n", F.negative("doc_id").alias("m"))).alias("x")).select((-F.col("x.m")).alias("doc_id"), F.lit("longest").alias("pick"))
    return M.union_first([drawn, ruled], "doc_id").select("doc_id", "pick")


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT s_suppkey::VARCHAR AS id, s_name AS name FROM supplier")
def csv_with_mark(spark, sf_dir):
    """Suppliers as delimited text that begins with a byte order mark."""
    path = _place(spark, "mark")
    s = table(spark, sf_dir, "supplier").select(F.concat_ws(",", "s_suppkey", "s_name").alias("value"), "s_suppkey")
    header = spark.range(1).select(F.lit("﻿id,name").alias("value"), F.lit(-1).cast("long").alias("s_suppkey"))
    header.unionByName(s).repartition(1).sortWithinPartitions("s_suppkey").select("value").write.text(path)
    return readers.csv(spark, path, ["id", "name"])


@query("SELECT user_id % 50 AS id, user_id % 50 % 7 <> 3 AS ok, CASE WHEN user_id % 50 % 7 <> 3 THEN count(*) END AS n FROM events GROUP BY 1, 2")
def parsed_record_files(spark, sf_dir):
    """Records of JSON files of a folder, a file for each of fifty groups of users; some files are cut off."""
    path = _place(spark, "parsed")
    g = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("id")).agg(F.count("*").alias("n"))
    value = F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.lit(', "n": '), F.col("n").cast("string"), F.when(F.col("id") % 7 == 3, "").otherwise("}"))
    g.select(value.alias("value"), F.col("id").alias("file")).repartition("file").write.partitionBy("file").text(path)
    got = readers.parsed_records(spark, path, "id long, n long", "*.txt")
    return got.select(F.regexp_extract("path", r"file=(\d+)", 1).cast("long").alias("id"), "ok", F.when(F.col("ok"), F.col("record.n")).alias("n"))


@query("SELECT p_size::BIGINT AS size, count(*)::BIGINT AS lines, min(p_partkey)::BIGINT AS first FROM (SELECT p_partkey, p_size FROM part) GROUP BY 1")
def text_corpus(spark, sf_dir):
    """Part keys in a text file for each size, read as one document each."""
    path = _place(spark, "corpus")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("value"), F.col("p_size").alias("size"), "p_partkey")
    p.repartition("size").sortWithinPartitions("size", "p_partkey").select("value", "size").write.partitionBy("size").text(path)
    lines = F.split(F.rtrim(F.regexp_replace("value", r"\n+$", "")), "\n")
    raw = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"size=(\d+)", 1).cast("long").alias("size"), lines.alias("l"))
    assert readers.texts(spark, path).count() == raw.count()
    return raw.select("size", F.size("l").cast("long").alias("lines"), F.col("l")[0].cast("long").alias("first"))


@query("""WITH n AS (SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT 1 AS k, '' AS o, '| segment | customers |' AS line UNION ALL SELECT 2, '', '|---|---|' UNION ALL SELECT 3, s, '| ' || s || ' | ' || n || ' |' FROM n) SELECT (row_number() OVER (ORDER BY k, o))::BIGINT AS nth, line FROM t""")
def markdown_lines(spark, sf_dir):
    """A small result as a table of a report, line by line."""
    small = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers")).orderBy("segment")
    return spark.createDataFrame([(i + 1, line) for i, line in enumerate(sinks.markdown(small).split("\n"))], "nth long, line string")


@query("""WITH s AS (SELECT *, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) // 200 AS part FROM customer)
SELECT replace(c_mktsegment, ' ', '_') || '_' || part || '.xlsx' AS path, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE count(*) END AS n_rows, CASE WHEN c_mktsegment <> 'BUILDING' THEN sum(c_custkey)::BIGINT END AS keys, CASE WHEN c_mktsegment <> 'BUILDING' THEN count(*) FILTER (c_nationkey % 2 = 0) END AS blank, CASE WHEN c_mktsegment = 'BUILDING' THEN 'missing_columns:note' ELSE '' END AS error FROM s GROUP BY c_mktsegment, part""")
def sheet_round_trip(spark, sf_dir):
    """Customers as rating sheets, two hundred rows each, read back; the sheets of one segment lack a column that is asked for."""
    c = table(spark, sf_dir, "customer").select(F.replace("c_mktsegment", F.lit(" "), F.lit("_")).alias("segment"), "c_custkey", "c_name", F.when(F.col("c_nationkey") % 2 == 1, F.concat(F.lit("<odd> & "), "c_name")).alias("note"))
    whole = sheets.sheets(c.where("segment <> 'BUILDING'"), "segment", ["c_custkey"], rows=200)
    keep = keeper(spark, "sheets")
    got = sheets.sheet_rows(keep(whole.unionByName(sheets.sheets(c.where("segment = 'BUILDING'").drop("note"), "segment", ["c_custkey"], rows=200))), ["c_custkey", "note"])
    by = got.groupBy("path").agg(F.count_if(F.col("error").isNull()).alias("n_rows"), F.sum(F.col("c_custkey").try_cast("long")).alias("keys"), F.count_if(F.col("note") == "").alias("b_"), F.coalesce(F.max("error"), F.lit("")).alias("error"))
    return by.select("path", "n_rows", "keys", F.when(F.col("error") == "", F.col("b_")).alias("blank"), "error")
