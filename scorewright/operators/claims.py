"""Claims in sentences: extraction, rule scores and document aggregates.

Extraction is a chain of built-in tests on sentences: each rule is an optional struct
in an array, and exploding the array yields the claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.rows import once
from scorewright.functions.text import contains_any, has_any, located_blocks, sentences, stripped_claim

#: Fixed vocabularies of the rules.
UP_WORDS = ("increase", "increased", "higher", "rise", "rises", "improved", "stronger", "growth")
DOWN_WORDS = ("decrease", "decreased", "decline", "declined", "lower", "fell", "reduced", "cautious")
METRICS = ("revenue", "profit", "sales", "margin", "cost", "cash flow")
CAUSE_WORDS = ("due to", "because", "driven by", "as ", "offset by")
COST_WORDS = ("raw material", "cost", "packaging", "logistics")
SEGMENT_WORDS = ("segment", "export", "domestic")
RISK_WORDS = ("risk", "uncertain", "pressure", "competition", "shortage")
OUTLOOK_WORDS = ("outlook", "expect", "forecast", "cautious")
STRATEGY_WORDS = ("strategy", "expansion", "capacity", "new product")
#: A sentence of a report without any of these makes no claim.
MDA_WORDS = tuple(dict.fromkeys((*METRICS, *CAUSE_WORDS, *COST_WORDS, *SEGMENT_WORDS, *RISK_WORDS, *OUTLOOK_WORDS, *STRATEGY_WORDS)))
CAUSE_SPLIT = r"(?i)\bdue to\b|\bbecause\b|\bdriven by\b|\boffset by\b|\bas\b"
DIMENSIONS = {
    "mda": {"financial_claim": ["AR02"], "causal_claim": ["AR03"], "cost_claim": ["AR03"], "segment_claim": ["AR03"], "risk_claim": ["AR04"], "outlook_claim": ["AR04"], "strategy_claim": ["AR03"]},
    "news": {"event_claim": ["N01"], "financial_event_claim": ["N01"], "market_claim": ["N04"], "risk_claim": ["N01"], "analyst_claim": ["N02"], "regulatory_claim": ["N01", "N02"]},
}


def direction(lowered: Column) -> Column:
    return F.when(has_any(lowered, UP_WORDS), "increase").when(has_any(lowered, DOWN_WORDS), "decrease").otherwise("neutral")


def metric(lowered: Column) -> Column:
    out = F.lit("")
    for m in reversed(METRICS):
        out = F.when(F.contains(lowered, F.lit(m)), m.replace(" ", "_")).otherwise(out)
    return out


def topic(lowered: Column) -> Column:
    rules = ((("export",), "export"), (("domestic",), "domestic_market"), (("raw material", "cost"), "cost"), (("revenue",), "revenue"), (("profit",), "profit"), (("sales",), "sales"), (("outlook", "expect"), "outlook"), (("risk", "pressure"), "risk"), (("regulator",), "regulatory"))
    out = F.lit("other")
    for terms, name in reversed(rules):
        out = F.when(has_any(lowered, terms), name).otherwise(out)
    return out


def stated_value(sentence: Column) -> Column:
    """The first number, or the first two with an arrow between."""
    found = F.regexp_extract_all(sentence, F.lit(r"((?:(?i:RM)\s*)?\d+(?:,\d{3})*(?:\.\d+)?%?)"), F.lit(1))
    return F.when(F.size(found) >= 2, F.concat(found[0], F.lit(" -> "), found[1])).when(F.size(found) == 1, found[0]).otherwise("")


def _claim(kind: str, topic_: Column | str, text: Column, way: Column | str, metric_: Column | str, value: Column | str = "") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(kind).alias("claim_type"), lit(topic_).alias("topic"), stripped_claim(text).alias("claim_text"), lit(value).alias("value"), lit(way).alias("direction"), lit(metric_).alias("metric_name"))


def _mda_rules(s: Column, low: Column, way: Column, what: Column, m: Column) -> Column:
    head = stripped_claim(F.split(s, CAUSE_SPLIT, 2)[0])
    financial = F.when((m != "") & (s.rlike(r"\d") | (way != "neutral")), _claim("financial_claim", m, F.when(head != "", head).otherwise(s), way, m, stated_value(s)))
    causes = F.split(s, CAUSE_SPLIT, 2)
    fragments = F.filter(F.transform(F.split(F.get(causes, 1), r"\band\b|,"), lambda x: stripped_claim(x)), lambda x: x != "")
    causal = F.when(has_any(low, CAUSE_WORDS) & (F.size(causes) > 1), F.transform(fragments, lambda x: _claim("causal_claim", topic(F.lower(x)), x, direction(F.lower(x)), "cause")))
    none = F.array().cast("array<struct<claim_type:string,topic:string,claim_text:string,value:string,direction:string,metric_name:string>>")
    rest = F.array(
        F.when(has_any(low, COST_WORDS), _claim("cost_claim", "cost", s, way, "cost")),
        F.when(has_any(low, SEGMENT_WORDS), _claim("segment_claim", what, s, way, "segment")),
        F.when(has_any(low, RISK_WORDS), _claim("risk_claim", what, s, "neutral", "risk")),
        F.when(has_any(low, OUTLOOK_WORDS), _claim("outlook_claim", "outlook", s, way, "outlook")),
        F.when(has_any(low, STRATEGY_WORDS), _claim("strategy_claim", "strategy", s, "neutral", "strategy")),
    )
    return F.array_compact(F.concat(F.array(financial), F.coalesce(causal, none), rest))


def _news_rules(s: Column, low: Column, way: Column, what: Column, m: Column, title: Column) -> Column:
    head = stripped_claim(F.split(s, CAUSE_SPLIT, 2)[0])
    found = F.array_compact(
        F.array(
            F.when((m != "") & (s.rlike(r"\d") | (way != "neutral")), _claim("financial_event_claim", m, F.when(head != "", head).otherwise(s), way, m, stated_value(s))),
            F.when(has_any(low, ["analyst"]), _claim("analyst_claim", what, s, way, "analyst_view")),
            F.when(has_any(low, ["market", "industry", "demand", "export", "domestic"]), _claim("market_claim", what, s, way, "market")),
            F.when(has_any(low, ["risk", "pressure", "safety", "shortage"]), _claim("risk_claim", what, s, "neutral", "risk")),
            F.when(has_any(low, ["regulator", "regulatory", "bursa"]), _claim("regulatory_claim", "regulatory", s, "neutral", "regulatory")),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(_claim("event_claim", what, s, way, title)))


def found(docs: DataFrame, source_type: str, *, id_col: str = "document_id", text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """Claims of each document before they are numbered: document_id, b_, s_, c_ (places of block, sentence and claim), evidence_locator, claim.

    Equal (type, topic, text) within a sentence count once. Null and empty texts give none.
    """
    mda = source_type == "mda"
    default = "[MDA_P001]" if mda else "[NEWS_P001]"
    title = F.coalesce(F.col(title_col), F.lit("")) if title_col else F.lit("")
    blocks = docs.select(F.col(id_col).alias("document_id"), title.alias("title_"), F.posexplode(located_blocks(F.coalesce(F.col(text_col), F.lit("")), default)).alias("b_", "block"))
    sents = blocks.select("document_id", "title_", "b_", F.col("block.locator").alias("evidence_locator"), F.posexplode(sentences(F.col("block.body"))).alias("s_", "sentence"))
    low = F.col("low_")
    sents = once(sents, low_=F.lower("sentence"))
    sents = once(sents.where(contains_any(low, MDA_WORDS)) if mda else sents, way_=direction(low), what_=topic(low), metric_=metric(low))
    of = [F.col(c) for c in ("sentence", "low_", "way_", "what_", "metric_")]
    rules = _mda_rules(*of) if mda else _news_rules(*of, F.col("title_"))
    same = lambda x, y: (x["claim_type"] == y["claim_type"]) & (x["topic"] == y["topic"]) & (x["claim_text"] == y["claim_text"])
    claims = F.col("claims_")
    first = F.filter(claims, lambda x, i: ~F.exists(F.slice(claims, F.lit(1), i), lambda y: same(x, y)))
    return sents.withColumn("claims_", rules).select("document_id", "b_", "s_", "evidence_locator", F.posexplode(first).alias("c_", "claim"))


def extracted(docs: DataFrame, source_type: str, *, id_col: str = "document_id", text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """found() numbered in order: claim_id, document_id, claim fields, evidence_locator, confidence."""
    rows = found(docs, source_type, id_col=id_col, text_col=text_col, title_col=title_col)
    # number the claims of a document within one list instead of a window over all rows
    lists = rows.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("b_", "s_", "c_", "evidence_locator", "claim"))).alias("all_"))
    out = lists.select("document_id", F.posexplode("all_").alias("n_", "r_"))
    return out.select(F.format_string("%s_CL%04d", F.col("document_id").cast("string"), F.col("n_") + 1).alias("claim_id"), "document_id", "r_.claim.*", "r_.evidence_locator", F.lit("high").alias("confidence"))


def rule_score(claims: DataFrame) -> Column:
    """1..5 score of a claim by fixed rules."""
    c, t = F.col, F.col("claim_type")
    bonus = lambda when: F.when(F.coalesce(when, F.lit(False)), 1).otherwise(0)
    score = F.lit(3) + bonus(c("evidence_locator") != "") + bonus(c("confidence") == "high") - bonus(c("confidence") == "low")
    score = score + bonus(t.isin("financial_claim", "financial_event_claim") & (c("value") != "") & c("direction").isin("increase", "decrease"))
    score = score + bonus(t.isin("causal_claim", "cost_claim", "segment_claim", "market_claim", "analyst_claim") & (F.size(F.split(F.trim("claim_text"), r"\s+")) >= 3))
    score = score + bonus(t.isin("risk_claim", "outlook_claim", "regulatory_claim"))
    return F.greatest(F.lit(1), F.least(F.lit(5), score)).cast("int")


def document_scores(claims: DataFrame, source_type: str, codes: list[str], breadth: tuple[str, ...], places: tuple[str, ...]) -> DataFrame:
    """One row per document with a 1..5 score for each dimension.

    A dimension is the mean of the scores of the claims mapped to it, rounded half to
    even, 3 without any; `breadth` dimensions follow the number of claim types, `places`
    the number of distinct locators. `claims` needs a column score.
    """
    mapping = DIMENSIONS[source_type]
    aggs = []
    for code in codes:
        types = [k for k, v in mapping.items() if code in v]
        if code in breadth:
            aggs.append(F.greatest(F.lit(1), F.least(F.lit(5), 2 + F.floor(F.count_distinct("claim_type") / 2))).cast("int").alias(code))
        elif code in places:
            aggs.append(F.greatest(F.lit(1), F.least(F.lit(5), 2 + F.count_distinct(F.when(F.col("evidence_locator") != "", F.col("evidence_locator"))))).cast("int").alias(code))
        else:
            mean = F.bround(F.avg(F.when(F.col("claim_type").isin(*types), F.col("score"))), 0) if types else F.lit(None).cast("double")
            aggs.append(F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(mean, F.lit(3.0)))).cast("int").alias(code))
    return claims.groupBy("document_id").agg(F.count("*").alias("claim_count"), *aggs)


def first_direction(lowered: Column, default: str) -> Column:
    """increased or decreased, by the change word that stands first; the default without any."""
    up, down = r"\b(increased|increase|improved|higher|rose|growth|expanded)\b", r"\b(decreased|decrease|declined|lower|fell|drop|reduced)\b"
    at = lambda p: F.when(lowered.rlike(p), F.length(F.regexp_replace(lowered, rf"(?s){p}.*$", "")))
    a, b = at(up), at(down)
    return F.when(a.isNotNull() & (b.isNull() | (a < b)), "increased").when(b.isNotNull(), "decreased").otherwise(default)


def link_claims_of(docs: DataFrame, doc_type: str, *, id_col: str = "document_id", text_col: str = "text", period: Column | None = None) -> DataFrame:
    """At most one claim of each sentence, by ordered topics, for linking reports with news.

    Columns: claim_id, document_id, claim_type, topic, metric_name, direction, period,
    claim_text, evidence_locator (a paragraph mark inside the sentence, else its number),
    source_attribution, source_independence. Null and empty texts give none.
    """
    flat = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\s+", " "))
    parts = F.filter(F.split(flat, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    s = docs.select(F.col(id_col).alias("document_id"), (F.lit("") if period is None else period.cast("string")).alias("period"), F.posexplode(parts).alias("n_", "claim_text"))
    low = F.lower("claim_text")
    say = lambda kind, what, name, way: F.struct(F.lit(kind).alias("claim_type"), F.lit(what).alias("topic"), F.lit(name).alias("metric_name"), (F.lit(way) if isinstance(way, str) else way).alias("direction"))
    claim = (
        F.when(has_any(low, ["raw material", "packaging", "logistics"]), say("cost_pressure", "raw_material", "raw_material_cost", first_direction(low, "increased")))
        .when(low.contains("revenue"), say("financial_result", "revenue", "revenue", first_direction(low, "unknown")))
        .when(low.contains("profit"), say("financial_result", "profit", "profit", first_direction(low, "unknown")))
        .when(low.contains("margin"), say("margin", "margin", "margin", F.when(low.contains("pressure"), first_direction(low, "decreased")).otherwise(first_direction(low, "unknown"))))
        .when(has_any(low, ["cautious outlook", "caution"]), say("outlook", "consumer_demand", "outlook", "cautious"))
        .when(has_any(low, ["explosive growth", "strong growth", "optimistic"]), say("outlook", "consumer_demand", "outlook", "optimistic"))
        .when(has_any(low, ["capacity", "production line", "expanded", "expansion"]), say("expansion", "capacity_expansion", "capacity", "increased"))
        .when(low.contains("food safety"), say("risk", "food_safety", "food_safety_issue", "negative"))
    )
    company, third = has_any(low, ["annual report", "bursa", "company announcement", "company said"]), has_any(low, ["regulator", "industry data", "market report", "analyst"])
    source = F.when(company, "company_or_filing").when(third, "third_party").when(low.contains("sources said"), "unnamed_sources").otherwise("")
    independence = F.when(company, "low").when(third, F.when(has_any(low, ["regulator", "industry data"]), "high").otherwise("medium")).otherwise("unknown" if doc_type == "news" else "")
    mark = F.regexp_extract("claim_text", r"\[(MDA_P\d+)\]", 1)
    rows = s.select("document_id", "period", "n_", "claim_text", F.when(mark != "", mark).otherwise(F.format_string("S%03d", F.col("n_") + 1)).alias("evidence_locator"), source.alias("source_attribution"), independence.alias("source_independence"), claim.alias("c_")).where("c_ is not null")
    lists = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("n_", "period", "claim_text", "evidence_locator", "source_attribution", "source_independence", "c_"))).alias("all_"))
    out = lists.select("document_id", F.posexplode("all_").alias("k_", "r_"))
    return out.select(F.format_string("%s_C%03d", F.col("document_id").cast("string"), F.col("k_") + 1).alias("claim_id"), "document_id", "r_.c_.*", "r_.period", "r_.claim_text", "r_.evidence_locator", "r_.source_attribution", "r_.source_independence")
