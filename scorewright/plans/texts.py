"""Queries on texts: counts, cleaning, duplicates, relevance, claims, context and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.functions import text as X
from scorewright.operators import aliases as A
from scorewright.operators import claims as C
from scorewright.operators import context as P
from scorewright.operators import dedupe as D
from scorewright.operators import jsonfix as J
from scorewright.operators import numeric as N
from scorewright.operators import relevance as V
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


#: Words of the test corpora that stand for the categories of a real dictionary.
CATEGORIES = {"articles": ["the", "der", "les", "los"], "links": ["and", "und", "et", "con"], "places": ["in", "dans", "from", "por"], "marks": ["%", "|"]}
#: Sentences that tests check the English rules on.
REPORT_SENTENCES = [
    ("R1", "Revenue increased by 20% from RM100 million to RM120 million due to higher export demand and lower raw material cost."),
    ("R2", "Profit decreased because packaging costs rose. The group expects a cautious outlook."),
    ("R3", "The domestic segment improved. Capacity expansion is part of the strategy; competition is a risk."),
    ("R4", "Margins fell. Sales grew, driven by new product launches, domestic growth and a stronger currency."),
    ("R5", "Nothing else happened."),
]
NEWS_SENTENCES = [
    ("W1", "Analysts said revenue rose 12%. The market expects stronger demand."),
    ("W2", "The regulator raised food safety concerns. Bursa was told."),
    ("W3", "A new canteen opened."),
    ("W4", "Profit declined 5% as export sales fell."),
]


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in rows)


_W = r"[\p{L}\p{N}_]"


@query(r"""WITH x AS (SELECT doc_id, text, len(regexp_extract_all(text, '\S+')) AS n_words, length(regexp_replace(text, '\s+', '', 'g')) AS dense, len(regexp_extract_all(text, '[0-9]')) AS digits, len(string_split(text, chr(10))) AS n_lines,
len(list_filter(string_split(text, chr(10)), lambda l: length(trim(l)) BETWEEN 1 AND 20)) AS short_lines FROM documents)
SELECT doc_id, n_words::BIGINT AS n_words, dense::BIGINT AS dense_chars, n_lines::BIGINT AS n_lines, round(digits::DOUBLE / greatest(dense, 1), 6) AS digit_ratio,
array_to_string(list_filter([CASE WHEN n_words < 50 THEN 'too_short' END, CASE WHEN digits::DOUBLE / greatest(dense, 1) > 0.2 THEN 'many_digits' END, CASE WHEN short_lines::DOUBLE / n_lines > 0.5 THEN 'many_short_lines' END], lambda r: r IS NOT NULL), ';') AS reasons FROM x""")
def text_quality_audit(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.split("text", "\n")
    d = d.select("doc_id", X.words(F.col("text")).alias("n_words"), X.dense_length(F.col("text")).alias("dense_chars"), F.regexp_count("text", F.lit("[0-9]")).alias("digits"), F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, lambda x: F.length(F.trim(x)).between(1, 20))).alias("short_lines"))
    ratio = F.col("digits") / F.greatest("dense_chars", F.lit(1))
    reasons = F.array_compact(F.array(F.when(F.col("n_words") < 50, "too_short"), F.when(ratio > 0.2, "many_digits"), F.when(F.col("short_lines") / F.col("n_lines") > 0.5, "many_short_lines")))
    return d.select("doc_id", "n_words", "dense_chars", "n_lines", F.round(ratio, 6).alias("digit_ratio"), F.array_join(reasons, ";").alias("reasons"))


_SENTENCES_SQL = r"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(trim(regexp_replace(s, '\s+', ' ', 'g')), '^[ ;,]+|[ ;,]+$', '', 'g')), lambda s: s <> '')"


@query(f"SELECT doc_id, len({_SENTENCES_SQL.format(t='text')})::BIGINT AS n_sentences FROM documents")
def sentence_split_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n_sentences"))


_TOKENS_SQL = r"greatest(len(regexp_extract_all({t}, '[A-Za-z]+(?:''[A-Za-z]+)?|\d+(?:[.,]\d+)*|[^\s]')), ceil(length({t}) / 4.0::DOUBLE)::BIGINT)::BIGINT"


@query(f"SELECT conv_id, turn, {_TOKENS_SQL.format(t='text')} AS token_estimate, 3776 - {_TOKENS_SQL.format(t='text')} AS tokens_left, {_TOKENS_SQL.format(t='text')} <= 3776 AS budget_passed FROM conversations")
def token_estimates(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.token_estimate(F.col("text")).alias("token_estimate"))
    return c.withColumn("b", P.budget_report(F.col("token_estimate"))).select("conv_id", "turn", "token_estimate", "b.tokens_left", "b.budget_passed")


def _hit_sql(t: str, k: str) -> str:
    return f"contains(lower({t}), '{k}')" if not k.isalnum() else f"regexp_matches(lower({t}), '(^|[^\\p{{L}}\\p{{N}}_]){k}([^\\p{{L}}\\p{{N}}_]|$)')"


def _count_sql(t: str, keys: list[str]) -> str:
    return "(" + " + ".join(f"{_hit_sql(t, k)}::INTEGER" for k in keys) + ")"


@query("SELECT source, lang, " + ", ".join(f"bool_or({_count_sql('text', k)} > 0) AS has_{n}, sum({_count_sql('text', k)})::BIGINT AS n_{n}" for n, k in CATEGORIES.items()) + " FROM documents GROUP BY source, lang")
def keyword_coverage_map(spark, sf_dir):
    return A.category_counts(table(spark, sf_dir, "documents"), CATEGORIES, F.col("text"), groups=["source", "lang"])


@query("WITH f AS (SELECT sha256(text) AS body, min(doc_id) AS first FROM documents GROUP BY 1) SELECT doc_id, sha256(text) AS body_sha256, doc_id > first AS is_repeat FROM documents JOIN f ON body = sha256(text)")
def duplicate_bodies_global(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("body_sha256"))
    return D.repeats(d, ["body_sha256"], ["doc_id"])


@query("WITH f AS (SELECT source, sha256(text) AS body, min(doc_id) AS first FROM documents GROUP BY 1, 2), g AS (SELECT sha256(text) AS body, count(DISTINCT source) AS n FROM documents GROUP BY 1) SELECT doc_id, d.source, doc_id > first AS is_repeat, n > 1 AS shared_article FROM documents d JOIN f ON f.body = sha256(text) AND f.source = d.source JOIN g ON g.body = f.body")
def duplicate_bodies_per_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("body"))
    shared = d.groupBy("body").agg(F.count_distinct("source").alias("n"))
    return D.repeats(d, ["source", "body"], ["doc_id"]).join(shared, "body").select("doc_id", "source", "is_repeat", (F.col("n") > 1).alias("shared_article"))


_FURNITURE = "(?i)" + "|".join(X.BOILERPLATE_LINES)


@query(rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM a),
c AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(t, '\r\n?', chr(10), 'g'), chr(10)), lambda l: trim(regexp_replace(l, '[ \t\f\x0B]+', ' ', 'g'))), lambda l: NOT regexp_matches(l, '{_FURNITURE}')), chr(10)) AS t FROM b)
SELECT page_id, regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS article FROM c""")
def html_article_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.plain_html(F.col("html")).alias("article"))


@query(r"SELECT page_id, lower(regexp_extract(url, 'https?://(?:www\.)?([^/]+)', 1)) AS source_name, CASE WHEN regexp_replace(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') = '' THEN 'UNKNOWN' ELSE regexp_replace(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') END AS safe_id, upper(left(sha256(url), 8)) AS url_key FROM pages")
def url_source_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.source_of(F.col("url")).alias("source_name"), X.safe_id(F.col("url")).alias("safe_id"), F.upper(F.substring(F.sha2("url", 256), 1, 8)).alias("url_key"))


#: Aliases of groups of documents; frequent words of the corpora stand for names.
ALIASES = [("src0", "thnd"), ("src1", "onthe"), ("src2", "erer"), ("src3", "sch der"), ("src4", "thing"), ("src5", "tion"), ("src6", "anesea"), ("src7", "de la"), ("src8", "ening"), ("src9", "erblend"), ("src10", "than"), ("src11", "ciónes")]


#: An alias table out of the words of `benchmark`: thousands of names, each of one source, longer ones surer.
_ALIASES_SQL = r"""words AS (SELECT min(item_id) AS item_id, w FROM (SELECT item_id, unnest(regexp_extract_all(text, '[\p{L}]+')) AS w FROM benchmark) GROUP BY w),
a AS (SELECT 'src' || (item_id + length(w)) % 20 AS ticker, w AS alias, CASE WHEN length(w) > 4 THEN 'strong' WHEN length(w) = 4 THEN 'medium' ELSE 'weak' END AS match_strength FROM words)"""


def benchmark_aliases(spark, sf_dir):
    w, n = F.col("w"), F.length("w")
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w")).groupBy("w").agg(F.min("item_id").alias("item_id"))
    return words.select(F.concat(F.lit("src"), ((F.col("item_id") + n) % 20).cast("string")).alias("ticker"), w.alias("alias"), F.when(n > 4, "strong").when(n == 4, "medium").otherwise("weak").alias("match_strength"))


@query(f"WITH {_ALIASES_SQL} SELECT doc_id, list_sort(list(alias)) AS hits FROM documents JOIN a ON ticker = source AND regexp_matches(text, '(?i)(^|[^A-Za-z0-9])' || alias || '([^A-Za-z0-9]|$)') GROUP BY doc_id")
def alias_hits_own_group(spark, sf_dir):
    return V.own_alias_hits(table(spark, sf_dir, "documents"), benchmark_aliases(spark, sf_dir), F.col("text"), id_col="doc_id", group_col="source")


@query(f"WITH {_ALIASES_SQL}, x AS (SELECT doc_id, list(alias ORDER BY ticker, alias) AS hits FROM documents JOIN a ON ticker <> source AND match_strength = 'strong' AND contains(lower(text), lower(alias)) GROUP BY doc_id) SELECT doc_id, hits[1:5] AS hits FROM x")
def alias_hits_other_group(spark, sf_dir):
    return V.other_alias_hits(table(spark, sf_dir, "documents"), benchmark_aliases(spark, sf_dir), F.col("text"), id_col="doc_id", group_col="source", order=["ticker"])


@query(rf"""WITH {_ALIASES_SQL}, d AS (SELECT doc_id, lower(text) AS t, ' ' || regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]', '  ', 'g') || ' ' AS words FROM documents),
h AS (SELECT doc_id, ticker, alias, array_position(['strong', 'medium', 'weak'], match_strength) AS sure, CASE WHEN match_strength = 'weak' THEN (length(words) - length(replace(words, ' ' || lower(alias) || ' ', ''))) // (length(alias) + 2) ELSE (length(t) - length(replace(t, lower(alias), ''))) // length(alias) END AS n FROM d JOIN a ON CASE WHEN match_strength = 'weak' THEN contains(words, ' ' || lower(alias) || ' ') ELSE contains(t, lower(alias)) END),
m AS (SELECT doc_id, sum(n) AS mentions FROM (SELECT DISTINCT doc_id, lower(alias), sure, n FROM h) GROUP BY 1)
SELECT doc_id, list(alias ORDER BY sure, ticker, alias) AS hits, any_value(mentions)::BIGINT AS mentions FROM h JOIN m USING (doc_id) GROUP BY doc_id""")
def alias_hits_any_group(spark, sf_dir):
    return V.any_alias_hits(table(spark, sf_dir, "documents"), benchmark_aliases(spark, sf_dir), F.col("text"), id_col="doc_id", order=["ticker"])


_COMPANIES_SQL = """co AS (SELECT 'T' || c_custkey AS ticker, lpad(c_custkey::VARCHAR, 5, '0') AS stock_code, c_mktsegment || ' ' || c_custkey || ' Holdings Berhad' AS company_name, c_mktsegment || ' ' || c_custkey AS short FROM customer),
al AS (SELECT ticker, company_name AS alias, 'legal_name' AS alias_type, 'strong' AS match_strength FROM co UNION ALL SELECT ticker, short, 'short_name', 'medium' FROM co UNION ALL SELECT ticker, ticker, 'ticker', 'weak' FROM co UNION ALL SELECT ticker, stock_code, 'stock_code', 'weak' FROM co)"""


def companies(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("T"), key).alias("ticker"), F.lpad(key, 5, "0").alias("stock_code"), F.concat("c_mktsegment", F.lit(" "), key, F.lit(" Holdings Berhad")).alias("company_name"))


@query(f"WITH {_COMPANIES_SQL} SELECT * FROM al")
def company_alias_table(spark, sf_dir):
    """Aliases of every customer as a company: legal and short name, ticker and code."""
    return V.alias_table(companies(spark, sf_dir))


@query(f"""WITH {_COMPANIES_SQL}, t AS (SELECT o_orderkey, 'T' || o_custkey AS ticker, CASE o_orderkey % 5 WHEN 0 THEN 'Talks of ' || lower(company_name) || ' ended' WHEN 1 THEN short || 's and others' WHEN 2 THEN 'Board: (t' || o_custkey || ')' WHEN 3 THEN 'code ' || stock_code || '; ' || upper(short) ELSE 'No. ' || o_custkey || '0 ' || ticker || '_' END AS text FROM orders JOIN co ON ticker = 'T' || o_custkey),
h AS (SELECT o_orderkey, alias FROM t JOIN al USING (ticker) WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || lower(alias) || '([^a-z0-9]|$)'))
SELECT o_orderkey, list_sort(list(alias)) AS hits FROM h GROUP BY 1""")
def order_alias_hits(spark, sf_dir):
    """A line about each order's customer, in one of five wordings: which of the customer's aliases it has. All customers' aliases make one table."""
    c, k = companies(spark, sf_dir), F.col("o_custkey").cast("string")
    o = table(spark, sf_dir, "orders").withColumn("ticker", F.concat(F.lit("T"), k)).join(c, "ticker")
    short = F.replace(F.col("company_name"), F.lit(" Holdings Berhad"), F.lit(""))
    kind = F.col("o_orderkey") % 5
    text = F.when(kind == 0, F.concat(F.lit("Talks of "), F.lower("company_name"), F.lit(" ended"))).when(kind == 1, F.concat(short, F.lit("s and others"))).when(kind == 2, F.concat(F.lit("Board: (t"), k, F.lit(")"))).when(kind == 3, F.concat(F.lit("code "), "stock_code", F.lit("; "), F.upper(short))).otherwise(F.concat(F.lit("No. "), k, F.lit("0 "), "ticker", F.lit("_")))
    return V.own_alias_hits(o.select("o_orderkey", "ticker", text.alias("text")), V.alias_table(c), F.col("text"), id_col="o_orderkey", group_col="ticker")


@query("""SELECT b.item_id, d.doc_id, strpos(d.text, b.text)::BIGINT AS place FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def phrase_containment(spark, sf_dir):
    """Documents that contain a phrase whole.

    Candidates share the rarest of a phrase's inner words, so texts meet phrases by an
    equi-join; its first and last word may stand inside longer words of a text. A phrase
    without an inner word is met by the rarest of its character grams. Empty phrases are
    in no text.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase")).where("phrase <> ''")
    parts = F.split("phrase", r"\s+")
    b = b.withColumn("inner_", F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: w != ""))
    pairs = _met(d, b.where(F.size("inner_") > 0), F.split("text", r"\s+"), F.col("inner_"))
    short = b.where(F.size("inner_") == 0)
    if not short.isEmpty():
        for n in (1, 2, 3):
            some = short.where(F.least(F.length("phrase"), F.lit(3)) == n)
            pairs = pairs.unionByName(_met(d, some, _grams("text", n), _grams("phrase", n)))
    b = b.select("item_id", "phrase")
    return pairs.join(b, "item_id").join(d, "doc_id").where(F.contains("text", F.col("phrase"))).select("item_id", "doc_id", F.instr("text", F.col("phrase")).cast("long").alias("place"))


def _grams(column: str, n: int):
    """Character grams of a text; none where it is shorter."""
    return F.when(F.length(column) >= n, F.transform(F.sequence(F.lit(1), F.length(column) - n + 1), lambda i: F.substring(F.col(column), i, F.lit(n))))


def _met(texts, phrases, text_keys, phrase_keys):
    """doc_id, item_id of the texts that have the rarest key of a phrase."""
    wanted = phrases.select("item_id", F.explode(F.array_distinct(phrase_keys)).alias("key"))
    found = texts.select("doc_id", F.explode(F.array_distinct(text_keys)).alias("key")).join(wanted.select("key").distinct(), "key")
    rare = wanted.join(found.groupBy("key").agg(F.count("*").alias("n")), "key", "left").groupBy("item_id").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("key"))
    return found.join(rare, "key").select("doc_id", "item_id")


_LEAD_SQL = "substring(text, 1, 200)"


def _relevance_sql(scope: str) -> str:
    own = " OR ".join(f"(source = '{g}' AND regexp_matches({{t}}, '(?i)(^|[^A-Za-z0-9]){a}([^A-Za-z0-9]|$)'))" for g, a in ALIASES)
    other = " OR ".join(f"(source <> '{g}' AND contains(lower(text), '{a}'))" for g, a in ALIASES if len(a) > 4)
    return f"""r AS (SELECT doc_id, source, text, '' AS url, doc_id > min(doc_id) OVER (PARTITION BY {scope} sha256(text)) AS dup, ({other}) AS other_hit, ({own.format(t="substring(text, 1, 60)")}) AS in_title, ({own.format(t=_LEAD_SQL)}) AS in_lead, ({own.format(t="text")}) AS anywhere,
  contains(lower(substring(text, 1, 60)), 'the of') AS generic, regexp_matches(lower({_LEAD_SQL}), 'the|der|les|los') AS ctx, regexp_matches(lower(text), 'idiot|clown') AS soft, regexp_matches(lower(text), 'and|und|et|con') AS biz FROM documents),
v AS (SELECT doc_id, CASE WHEN text = '' THEN ['unusable_missing_text', 'No', ''] WHEN starts_with(lower(text), 'http') AND length(text) < 200 THEN ['unusable_url_only', 'No', ''] WHEN length(text) < 200 THEN ['unusable_too_short', 'No', ''] WHEN dup THEN ['duplicate', 'No', '']
  WHEN other_hit AND NOT anywhere THEN ['wrong_company', 'No', 'wrong_company'] WHEN generic AND NOT anywhere THEN ['no_target_alias_industry_news', 'Manual', 'market_or_industry_story_without_target_alias'] WHEN generic THEN ['low_confidence_company_news', 'Manual', 'generic_market_title_with_target_alias']
  WHEN in_title AND ctx AND NOT soft THEN ['high_confidence_company_news', 'Yes', ''] WHEN in_lead AND ctx AND NOT soft THEN ['high_confidence_company_news', 'Yes', ''] WHEN soft AND anywhere THEN ['low_confidence_company_news', 'Manual', 'csr_sponsorship_lifestyle_review']
  WHEN (in_title OR in_lead) AND ctx THEN ['medium_confidence_company_news', 'Yes', ''] WHEN anywhere THEN ['low_confidence_company_news', 'Manual', 'weak_company_specific_context'] WHEN biz THEN ['no_target_alias_industry_news', 'Manual', 'manual_review_no_target_alias'] ELSE ['no_target_alias_industry_news', 'No', ''] END AS d FROM r)"""


def _relevance(spark, sf_dir, per_source: bool):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text").withColumn("body", F.sha2("text", 256))
    d = D.repeats(d, [*(["source"] if per_source else []), "body"], ["doc_id"], "dup")
    # a dotted capital I is one letter in lower case
    plain = F.translate("text", "İ", "i")
    own = lambda t: F.coalesce(*[F.when((F.col("source") == g) & t.rlike(X.alias_pattern(a)), True) for g, a in ALIASES], F.lit(False))
    other = F.coalesce(*[F.when((F.col("source") != g) & F.contains(F.lower(plain), F.lit(a)), True) for g, a in ALIASES if len(a) > 4], F.lit(False))
    title, lead = F.substring("text", 1, 60), F.substring("text", 1, 200)
    out = V.relevance(text=F.col("text"), url=F.lit(""), title=title, duplicate=F.col("dup"), wrong_company=other, alias_in_title=own(title), alias_in_lead=own(lead), alias_anywhere=own(F.col("text")), generic_title=X.has_any(title, ["the of"]), context=X.has_any(lead, ["the", "der", "les", "los"]), soft_story=X.has_any(plain, ["idiot", "clown"]), business=X.has_any(plain, ["and", "und", "et", "con"]))
    return d.select("doc_id", out.alias("r")).select("doc_id", "r.*")


@query(f"WITH {_relevance_sql('')} SELECT doc_id, d[1] AS relevance_status, d[2] AS include_flag, d[3] AS review_reason FROM v")
def relevance_decision_list(spark, sf_dir):
    return _relevance(spark, sf_dir, False)


@query(f"""WITH {_relevance_sql('')}, {_relevance_sql('source,').replace('r AS', 'r2 AS', 1).replace('v AS', 'v2 AS', 1).replace('FROM r)', 'FROM r2)')},
m AS (SELECT 'strict' AS filter_mode, d[1] AS s, CASE WHEN d[2] = 'Manual' OR d[1] = 'low_confidence_company_news' THEN 'No' ELSE d[2] END AS i FROM v UNION ALL SELECT 'preserve', d[1], d[2] FROM v2)
SELECT filter_mode, count(*) AS articles, count(*) FILTER (i = 'Yes') AS included, count(*) FILTER (i = 'Manual') AS manual, count(*) FILTER (s = 'duplicate') AS duplicates, count(DISTINCT CASE WHEN i = 'Yes' THEN s END) AS included_kinds FROM m GROUP BY 1""")
def relevance_mode_summary(spark, sf_dir):
    strict = _relevance(spark, sf_dir, False).withColumn("include_flag", V.strict_mode(F.col("relevance_status"), F.col("include_flag"))).withColumn("filter_mode", F.lit("strict"))
    both = strict.unionByName(_relevance(spark, sf_dir, True).withColumn("filter_mode", F.lit("preserve")))
    i, s = F.col("include_flag"), F.col("relevance_status")
    return both.groupBy("filter_mode").agg(F.count("*").alias("articles"), F.count_if(i == "Yes").alias("included"), F.count_if(i == "Manual").alias("manual"), F.count_if(s == "duplicate").alias("duplicates"), F.count_distinct(F.when(i == "Yes", s)).alias("included_kinds"))


def reports(spark, sf_dir):
    """Every document as a report."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")


def news(spark, sf_dir):
    """Every turn of a conversation as a news text of its own, so that a long conversation is no large group."""
    return table(spark, sf_dir, "conversations").select(F.format_string("%s_T%s", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("document_id"), "text")


@query(None)
def claims_extracted(spark, sf_dir):
    return C.extracted(spread(reports(spark, sf_dir)), "mda").unionByName(C.extracted(spread(news(spark, sf_dir)), "news"))


_UP = "|".join(C.UP_WORDS)
_DOWN = "|".join(C.DOWN_WORDS)
_SENT = f"s AS (SELECT doc_id::VARCHAR AS document_id, unnest({_SENTENCES_SQL.format(t='text')}) AS s FROM documents)"


@query(f"""WITH {_SENT}, l AS (SELECT document_id, lower(s) AS l FROM s),
c AS (SELECT 'cost_claim' AS claim_type, l FROM l WHERE regexp_matches(l, 'raw material|cost|packaging|logistics') UNION ALL SELECT 'segment_claim', l FROM l WHERE regexp_matches(l, 'segment|export|domestic') UNION ALL SELECT 'risk_claim', l FROM l WHERE regexp_matches(l, 'risk|uncertain|pressure|competition|shortage')
UNION ALL SELECT 'outlook_claim', l FROM l WHERE regexp_matches(l, 'outlook|expect|forecast|cautious') UNION ALL SELECT 'strategy_claim', l FROM l WHERE regexp_matches(l, 'strategy|expansion|capacity|new product')
UNION ALL SELECT 'financial_claim', l FROM l WHERE regexp_matches(l, 'revenue|profit|sales|margin|cost|cash flow') AND (regexp_matches(l, '\\d') OR regexp_matches(l, '{_UP}|{_DOWN}')))
SELECT claim_type, CASE WHEN claim_type = 'risk_claim' OR claim_type = 'strategy_claim' THEN 'neutral' WHEN regexp_matches(l, '{_UP}') THEN 'increase' WHEN regexp_matches(l, '{_DOWN}') THEN 'decrease' ELSE 'neutral' END AS direction, count(*) AS n FROM c GROUP BY 1, 2""")
def claim_type_counts(spark, sf_dir):
    """Claims by type and direction, but for causal ones."""
    claims = C.found(spread(reports(spark, sf_dir)), "mda").select("claim.claim_type", "claim.direction")
    return claims.where("claim_type <> 'causal_claim'").groupBy("claim_type", "direction").agg(F.count("*").alias("n"))


_TURNS = "x AS (SELECT conv_id AS document_id, role, turn, text, 1 + (length(text) + turn) % 5 AS score FROM conversations)"


@query(f"""WITH {_TURNS} SELECT document_id, count(*) AS claim_count, greatest(1, least(5, 2 + floor(count(DISTINCT CASE WHEN role = 'user' THEN 'financial_claim' ELSE 'risk_claim' END) / 2)))::INTEGER AS AR01, greatest(1, least(5, coalesce(round_even(avg(CASE WHEN role = 'user' THEN score END), 0), 3)))::INTEGER AS AR02,
3::INTEGER AS AR03, greatest(1, least(5, coalesce(round_even(avg(CASE WHEN role <> 'user' THEN score END), 0), 3)))::INTEGER AS AR04, greatest(1, least(5, 2 + count(DISTINCT turn)))::INTEGER AS AR05 FROM x GROUP BY document_id""")
def claim_document_scores(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    claims = c.select(F.col("conv_id").alias("document_id"), F.when(F.col("role") == "user", "financial_claim").otherwise("risk_claim").alias("claim_type"), F.col("turn").cast("string").alias("evidence_locator"), (1 + (F.char_length("text") + F.col("turn")) % 5).alias("score"))
    return C.document_scores(claims, "mda", ["AR01", "AR02", "AR03", "AR04", "AR05"], ("AR01",), ("AR05",))


@query(None)
def claim_rule_scores(spark, sf_dir):
    claims = claims_extracted(spark, sf_dir)
    return claims.select("claim_id", "claim_type", C.rule_score(claims).alias("score"))


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN 'Section ' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), 'Unknown') AS section FROM conversations")
def section_carry_forward(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return P.carried_forward(c, "conv_id", "turn", F.when(F.col("role") == "user", F.concat(F.lit("Section "), F.col("turn").cast("string"))), "section").select("conv_id", "turn", "section")


_PLACES = _count_sql("text", ["dans", "from", "nicht", "cada"])


@query(f"WITH h AS (SELECT conv_id, turn, {_PLACES} AS h FROM conversations) SELECT conv_id, turn, CASE WHEN h > 0 THEN 100 + h WHEN coalesce(lag(h) OVER w, 0) > 0 OR coalesce(lead(h) OVER w, 0) > 0 THEN 30 END::INTEGER AS selection FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbor_expansion(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return P.with_neighbors(c, "conv_id", "turn", X.keyword_count(F.col("text"), ["dans", "from", "nicht", "cada"])).select("conv_id", "turn", F.col("selection").cast("int").alias("selection"))


@query(f"WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?|\\d+(?:[.,]\\d+)*|[^\\s]')) AS k, length(text) AS n FROM conversations), r AS (SELECT conv_id, turn, greatest(sum(k) OVER w + 20, ceil((sum(n) OVER w + 80) / 4.0::DOUBLE))::BIGINT AS running_estimate, row_number() OVER w AS nth FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, running_estimate FROM r WHERE running_estimate <= 400 OR nth = 1")
def budget_prefix_cut(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_count("text", F.lit(r"[A-Za-z]+(?:'[A-Za-z]+)?|\d+(?:[.,]\d+)*|[^\s]")).cast("long").alias("k"), F.char_length("text").alias("n"))
    return P.budget_prefix(c, "conv_id", "turn", "k", "n", 400, header_tokens=20, header_chars=80).select("conv_id", "turn", "running_estimate")


_TOP = " UNION ALL ".join(f"SELECT conv_id, turn, '{n}' AS category, {_count_sql('text', k)} AS score FROM conversations" for n, k in CATEGORIES.items())


@query(f"WITH l AS ({_TOP}), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, category ORDER BY score DESC, turn) AS nth FROM l WHERE score > 0) SELECT conv_id, turn, category, score FROM r WHERE nth <= 2")
def top2_turns_per_category(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return P.top_per_category(c, "conv_id", "turn", {n: X.keyword_count(F.col("text"), k) for n, k in CATEGORIES.items()})


@query(r"WITH p AS (SELECT conv_id, length(text) AS n, greatest(1, len(regexp_extract_all(text, '[.!?]'))) AS s, substring(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), 1, 180) AS k FROM conversations) SELECT conv_id, count(*) AS paragraph_count, round(avg(n::DOUBLE / s), 3) AS mean_sentence_chars, min(n)::INTEGER AS min_chars, max(n)::INTEGER AS max_chars, round(avg(n), 3) AS mean_chars, round(1 - count(DISTINCT k)::DOUBLE / count(*), 6) AS repetition_ratio FROM p GROUP BY conv_id")
def paragraph_structure(spark, sf_dir):
    return P.structure(table(spark, sf_dir, "conversations"), "conv_id", F.col("text"))


@query("""WITH x AS (SELECT d.doc_id, len(regexp_extract_all(text, '\\S+')) AS w, 25.0::DOUBLE * ((d.doc_id * 7 + quality) % 5) AS s FROM documents d JOIN labels l USING (doc_id)),
m AS (SELECT count(*) AS n, avg(w) AS mw, stddev_samp(w) AS sw, stddev_samp(s) AS ss, covar_pop(w, s) AS cv, stddev_pop(w) AS pw, stddev_pop(s) AS ps, min(w) AS lo, max(w) AS hi, list(w ORDER BY w) AS l FROM x)
SELECT n, round(mw, 6) AS mean_words, l[(n // 2 + 1)::BIGINT]::BIGINT AS upper_median_words, lo::BIGINT AS min_words, hi::BIGINT AS max_words, round(sw, 6) AS stdev_words, round(ss, 6) AS stdev_score, CASE WHEN n < 3 THEN 0.0::DOUBLE ELSE round(cv / (pw * ps), 6) END AS pearson FROM m""")
def length_score_profile(spark, sf_dir):
    from scorewright.functions.numbers import pearson_of

    d = table(spark, sf_dir, "documents").select("doc_id", X.words(F.col("text")).alias("w"))
    x = d.join(table(spark, sf_dir, "labels"), "doc_id").select("w", (25.0 * ((F.col("doc_id") * 7 + F.col("quality")) % 5)).alias("s"))
    # the upper median: the least length with more than half of the rows at or below it
    counts = x.groupBy("w").agg(F.count("*").alias("c"))
    from pyspark.sql import Window

    total = F.sum("c").over(Window.partitionBy())
    upto = F.sum("c").over(Window.orderBy("w").rowsBetween(Window.unboundedPreceding, 0))
    median = counts.select("w", upto.alias("u"), total.alias("n")).where("u > floor(n / 2)").agg(F.min("w").alias("upper_median_words"))
    one = x.agg(F.count("*").alias("n"), F.round(F.avg("w"), 6).alias("mean_words"), F.min("w").alias("min_words"), F.max("w").alias("max_words"), F.round(F.stddev_samp("w"), 6).alias("stdev_words"), F.round(F.stddev_samp("s"), 6).alias("stdev_score"), pearson_of("w", "s", least=3).alias("pearson"))
    return one.join(F.broadcast(median), F.lit(True))


@query("""WITH x AS (SELECT d.doc_id, len(regexp_extract_all(text, '\\S+')) AS w, quality FROM documents d JOIN labels USING (doc_id)), r AS (SELECT *, row_number() OVER (ORDER BY w DESC, doc_id) AS a, row_number() OVER (ORDER BY w, doc_id) AS b FROM x)
SELECT 'longest' AS edge, count(*) AS n, round(avg(w), 6) AS mean_words, round(avg(quality), 6) AS mean_quality FROM r WHERE a <= 5 UNION ALL SELECT 'shortest', count(*), round(avg(w), 6), round(avg(quality), 6) FROM r WHERE b <= 5""")
def top5_longest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.words(F.col("text")).alias("w")).join(table(spark, sf_dir, "labels"), "doc_id")
    edge = lambda df, name: df.limit(5).agg(F.count("*").alias("n"), F.round(F.avg("w"), 6).alias("mean_words"), F.round(F.avg("quality"), 6).alias("mean_quality")).select(F.lit(name).alias("edge"), "*")
    return edge(d.orderBy(F.desc("w"), "doc_id"), "longest").unionByName(edge(d.orderBy("w", "doc_id"), "shortest"))


@query("SELECT event_id, true AS ok, props AS payload, '' AS failure_type, '' AS recommended_fix FROM events")
def json_props_valid(spark, sf_dir):
    return J.stabilized(table(spark, sf_dir, "events").select("event_id", "props"), "props").drop("props")


@query("SELECT event_id, coalesce(props ->> '$.score', props ->> '$.rating.score', props ->> '$.k') AS value FROM events")
def json_path_probe(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", J.probed(F.col("props"), ["$.score", "$.rating.score", "$.k"]).alias("value"))


@query(None)
def json_repair(spark, sf_dir):
    """Every event's payload in one of five broken wrappings, read back."""
    e = table(spark, sf_dir, "events").select("event_id", "props")
    wraps = [F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")), F.concat(F.lit("<think>hm</think>"), F.col("props")), F.concat(F.lit("Answer: "), F.col("props"), F.lit(" done")), F.replace(F.col("props"), F.lit('"'), F.lit("'")), F.regexp_replace("props", "}$", ",}")]
    n = F.col("event_id") % len(wraps)
    raw = wraps[-1]
    for i, w in enumerate(wraps[:-1]):
        raw = F.when(n == i, w).otherwise(raw)
    return J.stabilized(e.select("event_id", raw.alias("raw")), "raw").drop("raw")


@query(None)
def numeric_change_checks(spark, sf_dir):
    return N.numeric_checks(reports(spark, sf_dir))


@query(None)
def numeric_document_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return N.document_summary(d, N.numeric_checks(d))


@query("""WITH RECURSIVE f AS (SELECT doc_id, length(text) >= 200 AS fit, sha256(text) AS body, concat_ws('|', source, lang, lower(substring(text, 1, 24))) AS title FROM documents),
e AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, body, title FROM f WHERE fit),
r AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS bodies, []::VARCHAR[] AS titles, -1::BIGINT AS doc_id, false AS included
  UNION ALL SELECT i, CASE WHEN ok THEN list_append(bodies, body) ELSE bodies END, CASE WHEN ok THEN list_append(titles, title) ELSE titles END, doc_id, ok
  FROM (SELECT e.*, bodies, titles, NOT list_contains(bodies, body) AND NOT list_contains(titles, title) AS ok FROM r JOIN e ON e.i = r.i + 1))
SELECT f.doc_id, fit, coalesce(included, false) AS included FROM f LEFT JOIN r USING (doc_id)""")
def greedy_dedupe(spark, sf_dir):
    """The first of documents that share a text or a title; a title is source, language and the text's first 24 characters, as article titles are short."""
    from scorewright.sources.tables import keeper

    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("body"), F.concat_ws("|", "source", "lang", F.lower(F.substring("text", 1, 24))).alias("title_key"), (F.char_length("text") >= 200).alias("fit"))
    return D.greedy_dedupe(d, ["body", "title_key"], "doc_id", "fit", keeper(spark, "greedy")).select("doc_id", "fit", "included")
