"""Rules over registries and ratings: filters, audits, triage, defaults, and lookups by several keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.numbers import number_or, truthy
from scorewright.functions.text import blank_if_null, has_any

#: Fixed values of the rules.
SCOPE_REASONS = ("scope_violation", "out_of_scope", "outside research scope", "wrong_company", "not_target_company", "not_target_company_news", "not_company_news")
NOISE = ("registered office", "principal bankers", "board of directors", "corporate information", "notice of annual general meeting", "proxy form")
EVIDENCE_WORDS = {
    "AR01": ("operation", "business", "financial", "market", "risk", "outlook", "prospect", "revenue", "profit", "segment", "performance", "management discussion"),
    "AR02": ("revenue", "sales", "profit", "loss", "cost", "margin", "cash flow", "rm", "%", "segment", "dividend", "finance cost", "million", "sen"),
    "AR03": ("due to", "because", "driven by", "mainly attributable", "demand", "sales volume", "market", "export", "cost increase", "product", "segment", "growth", "decline"),
    "AR04": ("risk", "challenge", "uncertain", "outlook", "future", "prospect", "raw material", "supply chain", "foreign exchange", "competition", "regulation", "food safety", "halal"),
    "AR05": ("section", "table", "summary", "paragraph", "discussion", "analysis", "review", "structured", "segment", "outlook", "risk", "financial"),
}
MISSING_ISSUE = {"AR01": "too_generic", "AR03": "missing_causal_explanation", "AR04": "missing_risk_or_outlook", "AR05": "missing_structure_basis"}
FIXES = {"text_quality": "reduce_context_and_retry", "numeric_check": "numeric_checker_review", "ollama_timeout": "reduce_context_and_retry", "json_parse": "repair_json_and_retry", "schema_validation": "fix_prompt_and_retry", "missing_evidence": "fix_prompt_and_retry", "scope_violation": "manual_review", "manual_required": "manual_review", "unknown": "manual_review"}


def included(df: DataFrame, flag: str = "include_flag", *, lenient: bool = False, limit: int | None = None, order: str = "row_ord") -> DataFrame:
    """Rows to use: flag yes, or any truthy spelling if lenient; the first `limit` by `order` for a pilot."""
    out = df.where(truthy(F.col(flag)) if lenient else F.lower(F.trim(blank_if_null(F.col(flag)))) == "yes")
    return out if limit is None else out.orderBy(order).limit(limit)


def real_rows(df: DataFrame, flag: str = "synthetic_flag", notes: str = "notes") -> DataFrame:
    """Rows that are neither flagged nor noted as synthetic."""
    return df.where(~(truthy(F.col(flag)) | F.lower(blank_if_null(F.col(notes))).contains("synthetic_flag=true")))


def scope_violation(flag: Column, reasons: Column, status: Column) -> Column:
    """A set flag, one of SCOPE_REASONS in a list cut at ; , or |, or a status that says so."""
    parts = F.transform(F.split(F.lower(blank_if_null(reasons)), r"[;,|]"), lambda t: F.trim(t))
    state = F.lower(F.trim(blank_if_null(status)))
    return truthy(flag) | F.arrays_overlap(parts, F.array(*[F.lit(r) for r in SCOPE_REASONS])) | state.isin("wrong_company", "not_target_company_news") | state.startswith("unusable_")


def numeric_status(*texts: Column) -> Column:
    """What the remarks of a numeric dimension say, by ordered phrases."""
    low = F.lower(F.concat_ws(" ", *texts))
    return F.when(has_any(low, ["confirmed_numeric_failure", "numeric failure"]), "confirmed_numeric_failure").when(has_any(low, ["numeric_review_required", "numeric review"]), "numeric_review_required").when(has_any(low, ["not enough number", "insufficient numeric"]), "not_enough_numbers").otherwise("no_numeric_issue")


def discrepancy_triage(metric: Column, source: Column, note: Column, previous: Column, calculated: Column, stated: Column) -> Column:
    """struct<label, reason>: why a material discrepancy may be an artefact, by ordered rules."""
    low = F.lower(F.concat_ws(" ", source, note, metric))
    years = F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?<![\p{L}\p{N}_])(20\d{2})(?![\p{L}\p{N}_])"), F.lit(1))))
    say = lambda label, reason: F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"))
    return (
        F.when(low.contains("segment") & has_any(low, ["components sum", "total"]), say("parser_false_positive", "segment_total_mismatch"))
        .when(has_any(low, ["rm'000", "rm000", "million", "billion"]) & (F.abs(calculated) > 500), say("parser_false_positive", "unit_mismatch"))
        .when(low.contains("percentage point"), say("parser_false_positive", "percentage_points_vs_percent"))
        .when(previous < 0, say("needs_manual_review", "negative_base"))
        .when(low.contains("loss") & low.contains("profit"), say("needs_manual_review", "profit_loss_swing"))
        .when(years >= 3, say("parser_false_positive", "multiple_years_confusion"))
        .when(F.abs(F.abs(stated) - F.abs(calculated)) <= 3, say("parser_false_positive", "rounding"))
        .otherwise(say("real_discrepancy", "true_math_error"))
    )


def evidence_class(code: Column, evidence: Column, reason: Column) -> Column:
    """struct<status, issue, alignment, action> of quoted evidence: noise, missing content of its dimension, or how many of the dimension's words it has."""
    text, own = F.lower(F.concat_ws(" ", blank_if_null(evidence), blank_if_null(reason))), F.lower(blank_if_null(evidence))
    hits = F.lit(0)
    for c, terms in EVIDENCE_WORDS.items():
        hits = hits + F.when(code == c, sum((text.contains(t).cast("int") for t in terms[1:]), text.contains(terms[0]).cast("int"))).otherwise(0)
    say = lambda *x: F.struct(*[F.lit(v).alias(n) for v, n in zip(x, ("status", "issue", "alignment", "action"), strict=True)])

    def judged(n: Column) -> Column:
        out = F.when(F.trim(own) == "", say("not_checkable", "evidence_not_in_text", "not_checkable", "check_text_cleaning")).when(has_any(own, NOISE), say("invalid", "non_mda_noise", "misaligned", "check_text_cleaning"))
        out = out.when((code == "AR02") & (n == 0) & ~text.rlike(r"\d+(?:\.\d+)?\s*(?:%|million|sen|rm)"), say("invalid", "missing_financial_content", "misaligned", "rerun_dimension_only"))
        out = out.when((code == "AR02") & has_any(text, ["numeric", "not calculable"]), say("acceptable", "numeric_review_required", "partial", "manual_review"))
        for c, issue in MISSING_ISSUE.items():
            out = out.when((code == c) & (n == 0), say("weak", issue, "partial", "manual_review"))
        return out.when(n >= 2, say("strong", "none", "aligned", "accept")).otherwise(say("acceptable", "none", "aligned", "accept"))

    # the words are counted once, not in each rule
    return F.get(F.transform(F.array(hits), judged), F.lit(0))


def failure_stage(error: Column, parse_status: Column, schema_status: Column, n_words: Column, evidence_status: Column, scope_status: Column, numeric_issues: Column) -> Column:
    """struct<stage, action> of a failed record, by ordered rules."""
    low = F.lower(blank_if_null(error))
    stage = F.when(low.contains("timeout"), "ollama_timeout").when((parse_status == "parse_failed") | low.contains("json_parse"), "json_parse").when((schema_status == "invalid") | low.contains("schema"), "schema_validation").when(n_words < 80, "text_quality").when(evidence_status == "missing_or_invalid", "missing_evidence").when(scope_status == "scope_violation", "scope_violation").when(numeric_issues > 0, "numeric_check").when(low.contains("manual"), "manual_required").otherwise("unknown")
    action = reduce(lambda out, kv: out.when(stage == kv[0], kv[1]), list(FIXES.items())[1:], F.when(stage == "text_quality", FIXES["text_quality"]))
    return F.struct(stage.alias("stage"), action.alias("action"))


def rating_issues(code: Column, raw: Column, locator: Column, locator_found: Column, quote: Column, confidence: Column, remarks: Column, numeric_conflicts: Column) -> Column:
    """Issues of one rating in fixed order: range, locator, external claims, scope, empty evidence, numeric conflict, confidence."""
    score, low = raw.cast("string").try_cast("double"), F.lower(blank_if_null(remarks))
    return F.array_compact(
        F.array(
            F.when(score.isNull(), "raw_score_invalid").when(~score.cast("int").between(1, 5), "raw_score_out_of_range"),
            F.when(~F.coalesce(locator_found, F.lit(False)), "evidence_locator_invalid"),
            F.when((code == "AR02") & low.rlike(r"matches? (the )?(audited )?financial statements?"), "ar02_external_verification_claim"),
            F.when(low.rlike("audit report|corporate governance|notes to the financial statements|full annual report"), "scope_violation"),
            F.when((F.trim(blank_if_null(locator)) == "") | (F.trim(blank_if_null(quote)) == ""), "empty_evidence"),
            F.when((code == "AR02") & (score >= 4) & (numeric_conflicts > 0), "numeric_check_conflict"),
            F.when(F.lower(blank_if_null(confidence)) == "low", "low_confidence"),
            F.when((code == "AR02") & low.contains("not found in annual report"), "possible_mda_scope_violation"),
        )
    )


def violations(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """id, issue for each row and rule (a condition of being wrong) that holds; an empty result is a pass."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.select(id_col, F.explode(found).alias("issue"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def truncation(text: Column, most: int = 11_500) -> Column:
    """struct<original, kept, lost, share> of a text that is cut after `most` characters."""
    n = F.char_length(blank_if_null(text))
    lost = F.greatest(F.lit(0), n - most)
    return F.struct(n.alias("original_chars"), (n - lost).alias("kept_chars"), lost.alias("lost_chars"), F.round(lost / F.greatest(n, F.lit(1)), 6).alias("lost_share"))


def filled(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Blank columns set to their defaults; filled ones stay."""
    return df.withColumns({c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(v)) for c, v in defaults.items()})


def by_available_flag(df: DataFrame, preferred: str, other: str) -> DataFrame:
    """Rows whose preferred flag is yes if any row's is, else those whose other flag is."""
    yes = lambda c: F.coalesce(F.lower(F.trim(F.col(c))) == "yes", F.lit(False))
    some = df.agg(F.coalesce(F.bool_or(yes(preferred)), F.lit(False)).alias("some_"))
    return df.join(F.broadcast(some), F.lit(True)).where(F.when(F.col("some_"), yes(preferred)).otherwise(yes(other))).drop("some_")


def tasks(docs: DataFrame, codes: list[str], done: DataFrame | None = None, *, id_col: str = "document_id") -> DataFrame:
    """(document, dimension_code) for every document and dimension, but for those done already."""
    every = docs.select(id_col, F.explode(F.array(*[F.lit(c) for c in codes])).alias("dimension_code"))
    return every if done is None else every.join(done.select(id_col, "dimension_code"), [id_col, "dimension_code"], "left_anti")


def unscored(docs: DataFrame, codes: list[str], reason: str = "model_unavailable") -> DataFrame:
    """Rating rows without a score for every document and dimension, for manual work."""
    return tasks(docs, codes).select("document_id", "dimension_code", F.lit(None).cast("int").alias("raw_score"), F.lit("").alias("evidence_locator"), F.lit(reason).alias("parse_status"))


def overlaid(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Rows of `over`, with columns that only `base` has. Columns of both are taken from `over` even where blank."""
    only = [c for c in base.columns if c not in over.columns]
    return over.join(base.select(key, *only), key, "left")


def first_filled(base: DataFrame, sources: list[DataFrame], key: str, fields: list[str]) -> DataFrame:
    """Each field from the first source in which the key's value is not blank."""
    out = base
    for i, s in enumerate(sources):
        out = out.join(s.select(key, *[F.col(f).alias(f"s{i}_{f}") for f in fields]), key, "left")
    pick = [F.coalesce(*[F.nullif(F.trim(F.col(f"s{i}_{f}").cast("string")), F.lit("")) for i in range(len(sources))], F.lit("")).alias(f) for f in fields]
    return out.select(*base.columns, *pick)


def two_pass_lookup(rows: DataFrame, table: DataFrame, keys: list[str], better: str, order: str, value: str) -> DataFrame:
    """value of the table row with equal keys: one whose `better` column is equal too before others, then the first by `order`; null without any."""
    t = table.select(*[F.col(k).alias(f"t_{k}") for k in [*keys, better, order, value]])
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"t_{k}") for k in keys])
    rank = F.struct((F.col(better) != F.col(f"t_{better}")).cast("int"), F.col(f"t_{order}"))
    found = rows.select(*keys, better).distinct().join(t, on).groupBy(*keys, better).agg(F.min_by(f"t_{value}", rank).alias(value))
    return rows.join(found, [*keys, better], "left")


def membership(rows: DataFrame, members: DataFrame, key: str, fallback: Column, name: str) -> DataFrame:
    """Whether the key is among the members; the fallback condition if there are no members at all."""
    some = members.agg((F.count("*") > 0).alias("some_"))
    m = members.select(F.col(key).alias("m_")).distinct()
    out = rows.join(m, F.col(key) == F.col("m_"), "left").join(F.broadcast(some), F.lit(True))
    return out.withColumn(name, F.when(F.col("some_"), F.col("m_").isNotNull()).otherwise(F.coalesce(fallback, F.lit(False)))).drop("m_", "some_")


def with_constants(df: DataFrame, fixes: DataFrame, key: str, column: str, *, only_missing: bool) -> DataFrame:
    """A column overridden by a table of fixes, or only filled by it where null."""
    f = fixes.select(F.col(key).alias("f_"), F.col(column).alias("fix_"))
    value = F.coalesce(column, "fix_") if only_missing else F.coalesce("fix_", column)
    return df.join(f, F.col(key) == F.col("f_"), "left").withColumn(column, value).drop("f_", "fix_")


def batch_summary(df: DataFrame) -> DataFrame:
    """One row: records, successes, rate to three digits, mean duration of numeric durations."""
    ok = F.count_if(F.lower(F.trim("status")) == "success")
    seconds = number_or(F.col("duration"), float("nan"))
    return df.agg(F.count("*").alias("records"), ok.alias("succeeded"), F.round(F.coalesce(F.try_divide(ok, F.count("*")), F.lit(0.0)), 3).alias("success_rate"), F.round(F.avg(F.when(~F.isnan(seconds), seconds)), 3).alias("mean_seconds"))
