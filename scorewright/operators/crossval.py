"""Links between the claims of reports and of news, their relations, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.dates import time_alignment

#: Topics that are close to each other, and claim types that are. Fixed values.
TOPIC_GROUPS = (("raw_material", "cost", "margin", "supply_chain"), ("consumer_demand", "domestic_market", "competition"), ("capacity_expansion", "new_product", "strategy"), ("food_safety", "regulation"))
CLOSE_TYPES = ("performance", "financial_result", "margin", "cost_pressure", "market_condition")
UP = ("increased", "increase", "positive", "improved", "optimistic")
DOWN = ("decreased", "decrease", "negative", "declined", "cautious")
#: Hundredths, so that sums are exact.
INDEPENDENCE = {"high": 100, "medium": 67, "low": 33}


def topics_close(a: Column, b: Column) -> Column:
    out = a == b
    for group in TOPIC_GROUPS:
        out = out | (a.isin(*group) & b.isin(*group))
    return out


def directions_conflict(a: Column, b: Column) -> Column:
    a, b = F.lower(a), F.lower(b)
    return (a.isin(*UP) & b.isin(*DOWN)) | (a.isin(*DOWN) & b.isin(*UP))


def _topic_key(topic: Column) -> Column:
    """Equal for close topics: the number of a group, else the topic itself. No topic is in two groups."""
    out = F.concat(F.lit("="), topic)
    for i, group in enumerate(TOPIC_GROUPS):
        out = F.when(topic.isin(*group), F.lit(f"group {i}")).otherwise(out)
    return out


def _type_key(kind: Column) -> Column:
    """Equal for close claim types."""
    return F.when(kind.isin(*CLOSE_TYPES), F.lit("group")).otherwise(F.concat(F.lit("="), kind))


def best_documents(news: DataFrame, reports: DataFrame) -> DataFrame:
    """news columns plus mda_document_id and report_year of the best report of the same company.

    2 for a report whose year or the half year after it the article falls in, else 1,
    and 1 more for the same year; ties go to the report first in order (mda_ord).
    `news` has news_claim_id, ticker, publish_date; `reports` mda_document_id, ticker,
    report_year, mda_ord.

    So the first report of the article's year is best; without one that of the year
    before, for articles of the first half year; without one the company's first. A
    company's row holds the first report of each of its years, so an article meets one
    row, and is shuffled once, however many reports its company has.
    """
    packed = F.struct("mda_document_id", "report_year")
    yearly = reports.groupBy("ticker", F.col("report_year").cast("int").alias("year_")).agg(F.min_by(packed, "mda_ord").alias("report_"), F.min("mda_ord").alias("ord_"))
    of_year = F.when(F.col("year_").isNotNull(), F.struct("year_", "report_"))
    books = yearly.groupBy(F.col("ticker").alias("t_")).agg(F.min_by("report_", "ord_").alias("first_"), F.map_from_entries(F.collect_list(of_year)).alias("years_"))
    year = F.year("publish_date")
    prior = F.when(F.month("publish_date") <= 6, F.try_element_at("years_", year - 1))
    out = news.join(books, F.col("ticker") == F.col("t_"))
    return out.withColumn("best_", F.coalesce(F.try_element_at("years_", year), prior, "first_")).select(*news.columns, "best_.*")


def linked_claims(news: DataFrame, mda_claims: DataFrame) -> DataFrame:
    """Each news claim with the best claim of its report, null where none fits.

    Candidates have a close topic; only if there are none, a close claim type. Of
    those, +3 for the same topic, +2 type, +2 metric, +4 conflicting directions, +4
    cautious against optimistic; ties go to the first claim (claim_ord).

    Claims are alike if they agree in topic, type and direction, and in the metric where
    that is to count. Of claims alike in one report only the first can be best, and news
    claims that are alike have the same best one; so kinds of claims meet kinds of news
    claims, in blocks of report and close topic and of report and close type, each once
    with and once without equal metrics. A block holds no more pairs than there are pairs
    of labels, whatever the report's size.
    """
    labels = ["topic", "claim_type", "direction"]
    kinds = news.select("mda_document_id", *labels, "metric_name").distinct()
    claim = F.struct(F.col("claim_ord").alias("ord"), F.col("claim_id").alias("m_claim_id"))
    first = lambda *more: mda_claims.groupBy(F.col("mda_document_id").alias("d_"), *[F.col(c).alias(f"k_{c}") for c in (*labels, *more)]).agg(F.min(claim).alias("first_"))
    plain, exact = first(), first("metric_name").where("k_metric_name <> ''")
    c, m = F.col, lambda n: F.col(f"m_.{n}")
    holds = lambda when: F.coalesce(when, F.lit(False))
    plus = lambda when, n: F.when(holds(when), n).otherwise(0)
    score = plus(c("k_topic") == c("topic"), 3) + plus(c("k_claim_type") == c("claim_type"), 2) + plus(directions_conflict(c("k_direction"), c("direction")), 4) + plus((c("k_direction") == "cautious") & (c("direction") == "optimistic"), 4)
    told = F.struct(c("first_.ord"), c("first_.m_claim_id"), c("k_topic").alias("m_topic"), c("k_claim_type").alias("m_type"), c("k_direction").alias("m_direction")).alias("m_")

    def met(key, label: str) -> DataFrame:
        block = (c("mda_document_id") == c("d_")) & (key(c(f"k_{label}")) == key(c(label)))
        rank = lambda more: F.struct(holds(topics_close(c("k_topic"), c("topic"))).alias("near"), (score + more).alias("score"), (-c("first_.ord")).alias("before")).alias("rank_")
        alike = kinds.join(plain, block).select(*kinds.columns, told, rank(0))
        return alike.unionByName(kinds.join(exact, block & (c("k_metric_name") == c("metric_name"))).select(*kinds.columns, told, rank(2)))

    # a claim met in both blocks has one rank: close topics go first in either
    best = met(_topic_key, "topic").unionByName(met(_type_key, "claim_type")).groupBy(*kinds.columns).agg(F.max_by("m_", "rank_").alias("m_"))
    both = best.toDF(*[f"n_{x}" for x in kinds.columns], "m_")
    same = [c(x).eqNullSafe(both[f"n_{x}"]) for x in kinds.columns]
    return news.join(both, same, "left").select(*news.columns, m("m_claim_id"), m("m_topic"), m("m_type"), m("m_direction"))


def relation(row: DataFrame) -> DataFrame:
    """Adds relation_type, link_direction, support_level, four flags, confidence_level, time_alignment and review_required.

    Needs topic, claim_type, direction, source_independence, company_source, publish_date
    and report_year of the news claim and its report, and m_claim_id, m_topic, m_type and
    m_direction of the linked claim.
    """
    c = F.col
    none = c("m_claim_id").isNull()
    independence = F.when(F.lower(F.trim("source_independence")).isin("high", "medium", "low"), F.lower(F.trim("source_independence"))).otherwise("unknown")
    pack = lambda kind, way, support, flag, sure: F.struct(F.lit(kind).alias("relation_type"), F.lit(way).alias("link_direction"), F.lit(support).alias("support_level"), *[F.lit(int(flag == n)).alias(f"{n}_flag") for n in ("contradiction", "omission", "overstatement", "repetition")], F.lit(sure).alias("confidence_level"))
    close, same_way = topics_close(c("m_topic"), c("topic")), c("m_direction") == c("direction")
    r = (
        F.when(none & (c("claim_type").isin("risk", "regulation") | c("topic").isin("food_safety", "regulation")), pack("possible_omission", "news_contextualizes_mda", "unknown", "omission", "high"))
        .when(none, pack("insufficient_evidence", "no_direction", "unknown", "", "medium"))
        .when((independence == "low") & c("company_source"), pack("same_source_repetition", "bidirectional_support", "moderate", "repetition", "high"))
        .when((c("m_direction") == "cautious") & (c("direction") == "optimistic"), pack("qualification", "mda_qualifies_news", "weak", "overstatement", "high"))
        .when(directions_conflict(c("m_direction"), c("direction")), pack("contradiction", "contradiction", "conflicting", "contradiction", "high"))
        .when((c("claim_type") == "expansion") & (c("m_type") == "expansion"), pack("strong_support", "mda_supports_news", "strong", "", "high"))
        .when(c("topic").isin("raw_material", "supply_chain", "foreign_exchange", "consumer_demand", "competition"), pack("contextual_support", "news_supports_mda", "moderate", "", "medium"))
        .when(close & same_way & independence.isin("medium", "high"), pack("strong_support", "bidirectional_support", "strong", "", "medium"))
        .when(close, pack("partial_support", "bidirectional_support", "moderate", "", "medium"))
        .otherwise(pack("no_clear_relation", "no_direction", "none", "", "medium"))
    )
    out = row.withColumn("r_", r).withColumn("time_alignment", time_alignment(c("report_year"), c("publish_date"))).withColumn("source_independence", independence)
    strong, outside = c("r_.support_level") == "strong", c("time_alignment") == "outside_window"
    known_outside = strong & outside & (c("source_independence") != "unknown")
    out = out.withColumn("r_", c("r_").withField("support_level", F.when(strong & ((c("source_independence") == "unknown") | outside), "moderate").otherwise(c("r_.support_level"))).withField("relation_type", F.when(known_outside, "partial_support").otherwise(c("r_.relation_type"))))
    out = out.select(*[x for x in out.columns if x != "r_"], "r_.*")
    return out.withColumn("review_required", (c("contradiction_flag") + c("omission_flag") + c("overstatement_flag") + c("repetition_flag") > 0) | (c("relation_type") == "insufficient_evidence"))


def pair_summary(reports: DataFrame, links: DataFrame) -> DataFrame:
    """One row per report, with or without links: counts by relation, independence, support scores, cross-validation score, label and reasons."""
    kind = lambda name: F.count_if(F.col("relation_type") == name)
    way = lambda *names: F.col("link_direction").isin(*names)
    to_mda, to_news = way("news_supports_mda", "bidirectional_support"), way("mda_supports_news", "bidirectional_support")
    independence = F.lit(0)
    for name, value in INDEPENDENCE.items():
        independence = F.when(F.col("source_independence") == name, F.lit(value)).otherwise(independence)
    agg = links.groupBy("mda_document_id").agg(
        F.count_distinct("news_document_id").alias("num_related_news"),
        F.count("*").alias("num_claim_links"),
        *[kind(k).alias(n) for k, n in (("strong_support", "num_strong_support"), ("partial_support", "num_partial_support"), ("contextual_support", "num_contextual_support"), ("contradiction", "num_contradictions"), ("possible_omission", "num_possible_omissions"), ("same_source_repetition", "num_same_source_repetitions"))],
        F.sum("overstatement_flag").alias("num_news_overstatements"),
        F.sum(independence).alias("independence_"),
        F.max(F.when(to_mda & F.col("relation_type").isin("strong_support", "contextual_support"), 4).when(to_mda, 3).otherwise(1)).alias("mda_supported_"),
        F.max(F.when(to_news & (F.col("relation_type") == "strong_support"), 4).when(to_news, 3).otherwise(1)).alias("news_supported_"),
    )
    out = reports.join(agg, "mda_document_id", "left")
    counts = [c for c in agg.columns if c.startswith("num_")]
    out = out.fillna(0, counts).fillna(0, ["independence_"]).fillna(1, ["mda_supported_", "news_supported_"])
    c = F.col
    support = c("num_strong_support") + c("num_contextual_support") + c("num_partial_support")
    # thousandths, halves up
    mean = F.when(c("num_claim_links") > 0, F.expr("(20 * independence_ + num_claim_links) div greatest(1, 2 * num_claim_links)") / 1000.0).otherwise(0.0)
    bad = (c("num_contradictions") > 0) | (c("num_possible_omissions") > 0)
    triangulated = (support >= 3) & (c("independence_") >= 60 * c("num_claim_links")) & (F.least("mda_supported_", "news_supported_") >= 3)
    score = F.when(bad, 1).when(c("num_news_overstatements") > 0, 2).when(triangulated, 5).when(support >= 2, 4).otherwise(3)
    label = F.when(bad | (c("num_news_overstatements") > 0), "D = contradiction / omission risk").when(triangulated, "A = strong triangulation").when(support >= 2, "B = moderate triangulation").otherwise("C = weak or neutral triangulation")
    reasons = F.when(bad, F.array_compact(F.array(F.when(c("num_contradictions") > 0, "contradiction"), F.when(c("num_possible_omissions") > 0, "possible_omission")))).when(c("num_news_overstatements") > 0, F.array(F.lit("news_overstatement"))).otherwise(F.array().cast("array<string>"))
    return out.select(*reports.columns, *counts, mean.alias("avg_source_independence_score"), c("mda_supported_").alias("mda_supported_by_news_score"), c("news_supported_").alias("news_supported_by_mda_score"), score.alias("cross_validation_score"), label.alias("cross_validation_label"), (F.size(reasons) > 0).alias("review_required"), F.array_join(reasons, ";").alias("review_reasons"))


def systemic_conflict(links: DataFrame) -> DataFrame:
    """One row: contradictions, links, and whether there are three or more that make up over a fifth, or three in one report."""
    by = links.groupBy("mda_document_id").agg(F.sum("contradiction_flag").alias("c"), F.count("*").alias("n"))
    total = by.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("contradictions"), F.coalesce(F.sum("n"), F.lit(0)).alias("links"), F.coalesce(F.max("c"), F.lit(0)).alias("most_"))
    return total.select("contradictions", "links", (((F.col("contradictions") >= 3) & (F.col("contradictions") / F.greatest("links", F.lit(1)) > 0.2)) | (F.col("most_") >= 3)).alias("systemic_conflict"))
