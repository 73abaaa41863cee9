"""Cleaning and cutting of report and article texts, rule scorers, prompts and payload checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from scorewright.functions.rows import once
from scorewright.functions.text import MARK, blank_if_null, has_any, one_spaced, packed, sentences

#: Headings that open a section of a report, and words that mark a paragraph as financial. Fixed values.
SECTIONS = ("financial review", "business review", "operations review", "risk", "outlook", "prospects", "dividend", "overview")
FINANCIAL = r"(?i)revenue|profit|sales|margin|cash flow|dividend|rm\s*\d|%"
FURNITURE = r"(?i)ANNUAL REPORT \d{4}|CORPORATE GOVERNANCE|ADDITIONAL INFORMATION"
#: Outcomes of a numeric check that a summary of a document tells.
BAD = ("material_discrepancy", "severe_direction_conflict")
#: Fields of a complete payload and the flags in it.
PAYLOAD_FIELDS = ("document_id", "doc_type", "scoring_basis", "scorebook_version", "evidence_limitation", "dimension_scores", "flags", "overall_comment", "needs_review", "review_reasons")
PAYLOAD = "document_id string, doc_type string, scoring_basis string, scorebook_version string, evidence_limitation string, dimension_scores array<struct<dimension_code:string,raw_score:int,reason:string,evidence_locator:string,confidence_level:string>>, flags map<string,int>, overall_comment string, needs_review boolean, review_reasons array<string>"


def heading(line: Column) -> Column:
    """A short line mostly in capitals or with a section word."""
    letters, capitals = F.length(F.regexp_replace(line, r"[^\p{L}]", "")), F.length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
    return (F.length(line) <= 80) & (((letters > 0) & (capitals / F.greatest(letters, F.lit(1)) > 0.75)) | (has_any(line, SECTIONS) & ~line.rlike("[.!?]")))


def section_of(line: Column) -> Column:
    """The section that a heading opens, or null."""
    short = (F.length(line) <= 120) & ~line.rlike("[.!?]")
    out = F.lit(None).cast("string")
    for s in reversed(SECTIONS):
        out = F.when(short & F.lower(line).contains(s), s).otherwise(out)
    return out


def cleaned(docs: DataFrame, *, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """Paragraphs of report texts: document_id, paragraph (MDA_P###), section, text.

    Control characters, lone page numbers and running headers go; hyphenated line ends
    join; paragraphs are cut at blank lines; headings set the section of what follows
    and are left out; a paragraph that repeats an earlier one goes unless financial.
    """
    flat = F.regexp_replace(F.regexp_replace(blank_if_null(F.col(text_col)), "\r\n?", "\n"), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    lines = F.transform(F.split(flat, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    good = F.filter(lines, lambda x: ~x.rlike(r"^\d{1,3}$") & ~(x.rlike(FURNITURE) & (F.length(x) < 90) & ~x.rlike(FINANCIAL)))
    text = F.regexp_replace(F.array_join(good, "\n"), r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    # a heading at the top of a block is a block of its own
    text = F.regexp_replace(text, r"\n{2,}", MARK)
    blocks = docs.select(F.col(id_col).alias("document_id"), F.posexplode(F.split(text, MARK)).alias("b_", "block"))
    first, rest = F.substring_index("block", "\n", 1), F.expr("substring(block, length(substring_index(block, '\n', 1)) + 2)")
    parts = F.when(section_of(first).isNotNull() & (rest != ""), F.array(first, rest)).otherwise(F.array(F.col("block")))
    rows = blocks.select("document_id", "b_", F.posexplode(parts).alias("p_", "part")).select("document_id", (F.col("b_") * 2 + F.col("p_")).alias("ord_"), F.trim(F.regexp_replace("part", r"\s+", " ")).alias("text")).where("text <> ''")
    w = Window.partitionBy("document_id").orderBy("ord_")
    opened = rows.withColumn("own_", section_of(F.col("text")))
    placed = opened.withColumn("section", F.coalesce(F.last("own_", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("Unknown"))).where("own_ is null")
    key = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_]+", "")
    nth = F.row_number().over(Window.partitionBy("document_id", "key_").orderBy("ord_"))
    kept = placed.withColumn("key_", key).withColumn("nth_", nth).where((F.col("nth_") == 1) | F.col("text").rlike(FINANCIAL))
    return kept.select("document_id", F.format_string("MDA_P%03d", F.row_number().over(w)).alias("paragraph"), "section", "text")


def article_paragraphs(title: Column, text: Column, size: int = 450) -> Column:
    """Located text of an article: a title block, then paragraphs at blank lines, or sentences packed to `size` characters if there are none."""
    parts = _blank_parted(text)
    return _numbered(title, F.when(F.size(parts) > 1, parts).otherwise(packed(sentences(text), size)))


def _blank_parted(text: Column) -> Column:
    return F.filter(F.transform(F.split(blank_if_null(text), r"\n\s*\n+"), lambda p: one_spaced(p)), lambda p: p != "")


def _numbered(title: Column, chosen: Column) -> Column:
    numbered = F.transform(chosen, lambda p, i: F.concat(F.format_string("[NEWS_P%03d] ", i + 1), p))
    return F.concat(F.lit("[TITLE]\n"), one_spaced(title), F.lit("\n\n"), F.array_join(numbered, "\n\n"), F.lit("\n"))


def articles(texts: DataFrame, title: str, text: str, size: int = 450) -> DataFrame:
    """Adds `article`, the article_paragraphs() of columns; the cuts of a text are worked out once and sentences only where no blank line parts it."""
    cut = once(texts, parts_=_blank_parted(F.col(text)))
    cut = once(cut, chosen_=F.when(F.size("parts_") > 1, F.col("parts_")).otherwise(packed(sentences(F.col(text)), size)))
    return cut.withColumn("article", _numbered(F.col(title), F.col("chosen_"))).drop("parts_", "chosen_")


def notes_map(notes: Column) -> Column:
    """key=value pairs of a text, separated by semicolons; the last of equal keys wins, parts without = are passed over."""
    pairs = F.filter(F.transform(F.split(blank_if_null(notes), ";"), lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.regexp_replace(p, "^[^=]*=?", "")).alias("value"), F.contains(p, F.lit("=")).alias("ok"))), lambda p: p["ok"] & (p["key"] != ""))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))


def plain_signs(text: Column) -> Column:
    """Ligatures, typographic quotes and dashes in their plain form."""
    out = F.translate(blank_if_null(text), "‘’“”–— ", "''\"\"-- ")
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def placeholder(text: Column, title: Column, url: Column) -> Column:
    """Texts that only stand in for an article: a bare address, or words such as placeholder, lorem ipsum or test article."""
    low = F.lower(F.concat_ws(" ", text, title, url))
    return F.trim(blank_if_null(text)).rlike(r"^https?://\S+$") | has_any(low, ["placeholder", "lorem ipsum", "test article", "example.com/dummy"])


def shortened(text: Column, most: int) -> Column:
    """One-spaced text of at most `most` characters."""
    return F.rtrim(F.substring(one_spaced(text), 1, most))


def ingest_reasons(text: Column, title: Column, url: Column, date: Column, duplicate: Column) -> Column:
    """Why a raw article is left out, in order; a duplicate has that reason alone."""
    dense = F.length(F.regexp_replace(blank_if_null(text), r"\s+", ""))
    reasons = F.array_compact(F.array(F.when(F.trim(blank_if_null(text)) == "", "missing_article_text"), F.when(dense < 200, "short_article_text"), F.when(date.isNull(), "invalid_publish_date"), F.when(placeholder(text, title, url), "placeholder_or_non_article_text")))
    return F.when(duplicate, F.array(F.lit("duplicate"))).otherwise(reasons)


def rule_document_scores(text: Column, doc_type: str, numeric: Column | None = None) -> Column:
    """Deterministic stand-in scores of a document from plain cues; not a judgement of quality."""
    low = F.lower(blank_if_null(text))
    if doc_type == "mda":
        state = F.lit("not_enough_numbers") if numeric is None else numeric
        second = F.when(state == "strong", 4).when(state == "weak", 2).when(state == "problematic", 1).otherwise(3)
        return F.struct(F.lit(3).alias("AR01"), second.alias("AR02"), F.lit(3).alias("AR03"), F.when(has_any(low, ["risk", "outlook"]), 3).otherwise(2).alias("AR04"), F.lit(3).alias("AR05"))
    return F.struct(F.lit(3).alias("N01"), F.when(has_any(low, ["source", "according to"]), 4).otherwise(2).alias("N02"), F.when(has_any(low, ["shocking", "must buy"]), 2).otherwise(3).alias("N03"), F.lit(3).alias("N04"), F.when(low.contains("shocking"), 2).otherwise(3).alias("N05"))


def news_cue_scores(text: Column) -> Column:
    low = F.lower(blank_if_null(text))
    return F.struct(F.lit(3).alias("N01"), F.when(has_any(low, ["according to", "source"]), 4).otherwise(3).alias("N02"), F.lit(3).alias("N03"), F.when(has_any(low, ["market", "industry"]), 4).otherwise(3).alias("N04"), F.lit(3).alias("N05"))


def prompt(instructions: Column, metadata: Column, context: Column, tone: str = "", marker: str = "Example:") -> Column:
    """Instructions, metadata as JSON and context; a tone goes before the marker's first occurrence."""
    toned = F.regexp_replace(instructions, rf"(?s)^(.*?)\Q{marker}\E", f"$1{tone}{marker}") if tone else instructions
    return F.concat(toned, F.lit("\nMETADATA:\n"), F.to_json(metadata), F.lit("\n\nCONTEXT:\n"), blank_if_null(context))


def full_payload_issues(payload: Column, codes: list[str], flags: list[str], *, mda: bool = True) -> Column:
    """Sorted distinct issues of a complete payload: fields, dimension order and range, evidence, flags, scope."""
    p = F.from_json(payload, T._parse_datatype_string(PAYLOAD))
    keys = F.json_object_keys(payload)
    dims = F.coalesce(p["dimension_scores"], F.array().cast(T._parse_datatype_string(PAYLOAD)["dimension_scores"].dataType))
    have = F.transform(dims, lambda d: d["dimension_code"])
    missing = F.transform(F.array_except(F.array(*[F.lit(f) for f in PAYLOAD_FIELDS]), F.coalesce(keys, F.array().cast("array<string>"))), lambda f: F.concat(F.lit("missing_top_field_"), f))
    flag_issues = F.array(*[F.when(~F.coalesce(F.try_element_at(p["flags"], F.lit(f)).isin(0, 1), F.lit(False)), f"invalid_flag_{f}") for f in flags])
    rules = F.array(
        F.when(~F.coalesce(p["doc_type"].isin("mda", "news"), F.lit(False)), "invalid_doc_type"),
        F.when(F.size(dims) != len(codes), f"dimension_count_not_{len(codes)}"),
        F.when(have != F.array(*[F.lit(c) for c in codes]), "dimension_codes_not_expected_order"),
        F.when(F.exists(dims, lambda d: ~F.coalesce(d["raw_score"].between(1, 5), F.lit(False))), "raw_score_out_of_range"),
        F.when(F.exists(dims, lambda d: F.coalesce(d["evidence_locator"], F.lit("")) == ""), "empty_evidence_locator"),
        F.when(F.exists(dims, lambda d: ~F.coalesce(d["confidence_level"].isin("high", "medium", "low"), F.lit(False))), "invalid_confidence_level"),
        F.when(F.lit(mda) & F.lower(payload).rlike("audited financial statements match|matches the audited financial statements"), "scope_violation"),
    )
    issues = F.array_sort(F.array_distinct(F.array_compact(F.concat(missing, flag_issues, rules))))
    return F.when(F.try_parse_json(payload).isNull(), F.array(F.lit("json_parse_failed"))).otherwise(issues)


def compact_numeric(checks: Column, most: int = 20) -> Column:
    """Status, locator and text of the first material or conflicting checks of a document."""
    bad = F.filter(checks, lambda c: c["status"].isin(*BAD))
    return F.slice(F.transform(bad, lambda c: F.struct(c["status"].alias("status"), c["evidence_locator"].alias("evidence_locator"), c["source_text"].alias("source_text"))), 1, most)


def compact_by_group(checks: DataFrame, group: str, order: list[str], most: int = 20) -> DataFrame:
    """group, c: compact_numeric() of each group's checks in `order`. Tasks keep `most` of each group before the shuffle, so a large group is not gathered."""
    bad = checks.where(F.col("status").isin(*BAD))
    first = bad.withColumn("nth_", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("nth_") <= most)
    entry = F.struct("nth_", "status", "evidence_locator", "source_text")
    return first.groupBy(group).agg(F.array_sort(F.collect_list(entry)).alias("checks_")).select(group, F.explode(compact_numeric(F.col("checks_"), most)).alias("c"))
