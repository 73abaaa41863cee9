"""Which articles are about which company: aliases, context and an ordered decision list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.rows import once
from scorewright.functions.text import alias_pattern, has_any, one_spaced
from scorewright.operators.aliases import names_held, own_names_found

#: Words of a company's legal form that its short name leaves out. Fixed values.
LEGAL_WORDS = r"(?i)\b(Berhad|Bhd|Holdings?|Corporation|Industries|Group|Malaysia)\b"


def alias_table(companies: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """ticker, alias, alias_type, match_strength from (ticker, stock_code, company_name) and curated rows of that shape; the first of equal aliases wins."""
    name, ticker = one_spaced(F.col("company_name")), F.upper(one_spaced(F.col("ticker")))
    short = one_spaced(F.regexp_replace(name, LEGAL_WORDS, ""))
    good = (F.length(name) > 5) & (F.upper(name) != ticker) & ~has_any(name, ["annual report", "annual review", "ar report", "part 1", "part i"])
    rows = F.array_compact(
        F.array(
            F.when(good, _alias(name, "legal_name", "strong", 0)),
            F.when(good & (F.length(short) > 4) & (F.lower(short) != F.lower(name)), _alias(short, "short_name", "medium", 1)),
            F.when(ticker != "", _alias(ticker, "ticker", "weak", 2)),
            F.when(one_spaced(F.col("stock_code")) != "", _alias(one_spaced(F.col("stock_code")), "stock_code", "weak", 3)),
        )
    )
    out = companies.select(ticker.alias("ticker"), F.explode(rows).alias("a")).select("ticker", "a.*")
    if curated is not None:
        out = out.unionByName(curated.select("ticker", "alias", "alias_type", "match_strength", F.lit(4).alias("ord_")))
    first = out.where("alias <> ''").groupBy("ticker", F.lower("alias").alias("key_")).agg(F.min_by(F.struct("alias", "alias_type", "match_strength"), "ord_").alias("a"))
    return first.select("ticker", "a.*")


def _alias(alias: Column, kind: str, strength: str, ord_: int) -> Column:
    return F.struct(alias.alias("alias"), F.lit(kind).alias("alias_type"), F.lit(strength).alias("match_strength"), F.lit(ord_).alias("ord_"))


def own_alias_hits(articles: DataFrame, aliases: DataFrame, text: Column, *, id_col: str, group_col: str) -> DataFrame:
    """id, hits (sorted aliases of the article's own group that stand in it between word borders)."""
    a = aliases.select(F.col("ticker").alias("group_"), "alias", F.lower(one_spaced(F.col("alias"))).alias("name"))
    own = own_names_found(articles, a, text, id_col=id_col, group_col=group_col)
    return own.groupBy(id_col).agg(F.array_sort(F.collect_set("alias")).alias("hits"))


def other_alias_hits(articles: DataFrame, aliases: DataFrame, text: Column, *, id_col: str, group_col: str, order: list[str], most: int = 5) -> DataFrame:
    """id, hits: the first `most` strong aliases (longer than four characters, by `order`) of other groups that stand in a text, wherever."""
    spaced = one_spaced(F.col("alias"))
    a = aliases.where((F.col("match_strength") == "strong") & (F.length(spaced) > 4)).select(F.struct(F.struct(*order, "alias").alias("a_"), F.col("ticker").alias("g_")).alias("told"), F.lower(spaced).alias("name"), F.lit("any").alias("rule"))
    held = names_held(articles.select(id_col, F.col(group_col).alias("group_"), text.alias("body_")), a, F.col("body_"), keep=[id_col, "group_"], told="told")
    # equal ones are neighbours: a text tells no more than `most`
    others = F.filter("held_", lambda x: x["g_"] != F.col("group_"))
    start = F.array().cast(held.schema["held_"].dataType)
    few = F.aggregate(others, start, lambda kept, x: F.when((F.size(kept) < most) & ~F.coalesce(F.get(kept, F.size(kept) - 1)["a_"].eqNullSafe(x["a_"]), F.lit(False)), F.concat(kept, F.array(x))).otherwise(kept))
    first = once(held, few_=few).select(id_col, F.transform("few_", lambda x: x["a_"]).alias("a_")).where(F.size("a_") > 0)
    by = first.groupBy(id_col).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("a_")))).alias("a_"))
    return by.select(id_col, F.transform(F.slice("a_", 1, most), lambda x: x["alias"]).alias("hits"))


def any_alias_hits(articles: DataFrame, aliases: DataFrame, text: Column, *, id_col: str, order: list[str]) -> DataFrame:
    """id, hits, mentions: aliases of any group in a text, strong ones first and then by `order`, and how often they stand there. Weak ones count at word borders, others wherever."""
    a = aliases.select(F.struct(F.array_position(F.array(F.lit("weak"), F.lit("medium"), F.lit("strong")), F.col("match_strength")).cast("int").alias("sure"), *order, "alias").alias("a_"), F.lower(F.trim("alias")).alias("name"), F.when(F.col("match_strength") == "weak", "edge").otherwise("any").alias("rule"))
    a = a.withColumn("a_", F.col("a_").withField("sure", -F.col("a_.sure")))
    held = names_held(articles.select(id_col, text.alias("body_")), a, F.col("body_"), keep=[id_col], told="a_")
    by = held.groupBy(id_col).agg(F.collect_list(F.struct("held_", "times_", "total_")).alias("l_"))
    alone, one = F.size("l_") == 1, F.get("l_", F.lit(0))
    # several rows: texts with one id, or names in several automata; names that differ in case alone are one name and are mentioned together
    every = F.flatten(F.transform("l_", lambda x: F.zip_with(x["held_"], x["times_"], lambda a, n: F.struct(a.alias("a"), n.alias("n")))))
    named = F.array_distinct(F.transform(every, lambda e: F.struct(F.lower(F.trim(e["a"]["alias"])).alias("name"), e["a"]["sure"].eqNullSafe(-1).alias("weak"), e["n"].alias("n"))))
    hits = F.when(alone, one["held_"]).otherwise(F.array_sort(F.array_distinct(F.transform(every, lambda e: e["a"]))))
    mentions = F.when(alone, one["total_"]).otherwise(F.aggregate(named, F.lit(0).cast("long"), lambda s, x: s + x["n"]))
    return by.select(id_col, F.transform(hits, lambda x: x["alias"]).alias("hits"), mentions.alias("mentions"))


def decided(rules: list[tuple[Column, str, str, str]], default: tuple[str, str, str]) -> Column:
    """First rule that holds, as struct<relevance_status, include_flag, review_reason>."""
    pack = lambda s, i, r: F.struct(F.lit(s).alias("relevance_status"), F.lit(i).alias("include_flag"), F.lit(r).alias("review_reason"))
    out = pack(*default)
    for when, status, include, reason in reversed(rules):
        out = F.when(F.coalesce(when, F.lit(False)), pack(status, include, reason)).otherwise(out)
    return out


def relevance(*, text: Column, url: Column, title: Column, duplicate: Column, wrong_company: Column, alias_in_title: Column, alias_in_lead: Column, alias_anywhere: Column, generic_title: Column, context: Column, soft_story: Column, business: Column, least: int = 200) -> Column:
    """Ordered decision list for one article; conditions are columns, so it needs no data of its own."""
    length = F.length(text)
    rules = [
        ((text == "") & (url != ""), "unusable_url_only", "No", ""),
        (text == "", "unusable_missing_text", "No", ""),
        (F.lower(text).startswith("http") & (length < least), "unusable_url_only", "No", ""),
        (length < least, "unusable_too_short", "No", ""),
        (duplicate, "duplicate", "No", ""),
        (wrong_company & ~alias_anywhere, "wrong_company", "No", "wrong_company"),
        (generic_title & ~alias_anywhere, "no_target_alias_industry_news", "Manual", "market_or_industry_story_without_target_alias"),
        (generic_title, "low_confidence_company_news", "Manual", "generic_market_title_with_target_alias"),
        (alias_in_title & context & ~soft_story, "high_confidence_company_news", "Yes", ""),
        (alias_in_lead & context & ~soft_story, "high_confidence_company_news", "Yes", ""),
        (soft_story & alias_anywhere, "low_confidence_company_news", "Manual", "csr_sponsorship_lifestyle_review"),
        ((alias_in_title | alias_in_lead) & context, "medium_confidence_company_news", "Yes", ""),
        (alias_anywhere, "low_confidence_company_news", "Manual", "weak_company_specific_context"),
        (business, "no_target_alias_industry_news", "Manual", "manual_review_no_target_alias"),
    ]
    return decided(rules, ("no_target_alias_industry_news", "No", ""))


def strict_mode(status: Column, include: Column) -> Column:
    """In strict mode nothing is left to manual review, and low confidence is out."""
    return F.when((include == "Manual") | (status == "low_confidence_company_news"), "No").otherwise(include)


__all__ = ["alias_pattern", "alias_table", "any_alias_hits", "decided", "other_alias_hits", "own_alias_hits", "relevance", "strict_mode"]
