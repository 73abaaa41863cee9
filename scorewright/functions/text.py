"""Text expressions: cleaning, splitting, counting and keyword tests, all with built-in functions.

Patterns that must also run in other regular-expression dialects use explicit classes
instead of \\w or \\b: `[\\p{L}\\p{N}_]` is a word character.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines of an article that are advertisements or page furniture. Fixed values.
BOILERPLATE_LINES = (
    "^advertisement$",
    "^related articles?$",
    "^subscribe now$",
    "^sign up for.*newsletter",
    "^for more stories",
    "^follow us on",
    "^copyright\\b",
    "^all rights reserved",
    "^cookie policy",
    "^privacy policy",
    "^terms of use",
    "^click here",
)
#: Separator put where a text is to be split; it does not occur in clean text.
MARK = "\u0001"
#: White space, and its runs other than one blank; most characters are passed over by the first test.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{001C}-\x{001F}]"
WIDE_SPACE = rf"(?=[^!-~])(?! (?!{SPACE})){SPACE}+"


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def one_spaced(c: Column) -> Column:
    """White space runs become one space, byte order marks go, ends are trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.replace(blank_if_null(c), F.lit("﻿"), F.lit(" ")), WIDE_SPACE, " "))


def stripped_claim(c: Column) -> Column:
    """one_spaced() without leading and trailing blanks, semicolons and commas."""
    return F.btrim(one_spaced(c), F.lit(" ;,"))


def sentences(c: Column) -> Column:
    """Sentences of a text: cut after . ! or ? before white space, and at line ends; blank ones go."""
    parts = F.split(F.regexp_replace(blank_if_null(c), r"([.!?])\s+|\n+", "$1" + MARK), MARK)
    return F.filter(F.transform(parts, lambda s: stripped_claim(s)), lambda s: s != "")


def located_blocks(c: Column, default: str = "[MDA_P001]") -> Column:
    """array<struct<locator, body>>: the text after each [MDA_P###], [NEWS_P###], [TITLE] or [LEAD] mark; without marks the whole text under `default`."""
    marked = F.regexp_replace(c, r"\[(MDA_P\d{3}|NEWS_P\d{3}|TITLE|LEAD)\]", MARK + "[$1]" + MARK + MARK)
    split = F.split(marked, MARK + r"(?=\[)")
    parts = F.slice(split, F.lit(2), F.size(split))
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, MARK + MARK, 1).alias("locator"), F.trim(F.regexp_replace(F.substring_index(p, MARK + MARK, -1), r"^\s+|\s+$", "")).alias("body")))
    found = F.filter(pairs, lambda p: p["body"] != "")
    whole = F.array(F.struct(F.lit(default).alias("locator"), c.alias("body")))
    return F.when(c.rlike(r"\[(MDA_P\d{3}|NEWS_P\d{3}|TITLE|LEAD)\]"), found).otherwise(whole)


def located_text(c: Column, locator: Column, most: int) -> Column:
    """The text under a locator (with or without brackets), one-spaced, of at most `most` characters; empty where there is none."""
    name = F.concat(F.lit("["), F.regexp_replace(blank_if_null(locator), r"[\[\]]", ""), F.lit("]"))
    found = F.filter(located_blocks(c), lambda b: b["locator"] == name)
    return F.rtrim(F.substring(one_spaced(F.get(found, F.lit(0))["body"]), 1, most))


def token_estimate(c: Column) -> Column:
    """Conservative number of model tokens: the greater of word-like pieces and a quarter of the characters, rounded up."""
    pieces = F.regexp_count(c, F.lit(r"[A-Za-z]+(?:'[A-Za-z]+)?|\d+(?:[.,]\d+)*|[^\s]"))
    return F.when(F.length(blank_if_null(c)) == 0, 0).otherwise(F.greatest(pieces, F.ceil(F.length(c) / 4))).cast("long")


def words(c: Column) -> Column:
    """Number of words that white space separates."""
    return F.size(F.filter(F.split(blank_if_null(c), r"\s+"), lambda w: w != "")).cast("long")


def dense_length(c: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(blank_if_null(c), r"\s+", "")).cast("long")


def has_any(c: Column, terms: Iterable[str]) -> Column:
    """Whether a lower-cased text contains any of the terms: one alternation, one scan."""
    return F.coalesce(F.lower(c).rlike("|".join(re.escape(t.lower()) for t in terms)), F.lit(False))


def contains_any(lowered: Column, terms: Iterable[str]) -> Column:
    """Like has_any() of a column that is lower-cased already: plain searches, which for many terms take less time than one pattern."""
    return F.coalesce(reduce(Column.__or__, [F.contains(lowered, F.lit(t.lower())) for t in terms]), F.lit(False))


def keyword_hit(lowered: Column, keyword: str) -> Column:
    """Whether a keyword stands in a lower-cased text: as a word if it is one, else as a substring; `rm` also before digits."""
    key = keyword.lower()
    if key == "rm":
        return lowered.rlike(r"(^|[^\p{L}\p{N}_])rm([^\p{L}_]|$)")
    if re.fullmatch(r"[a-z0-9]+", key):
        return lowered.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){key}([^\p{{L}}\p{{N}}_]|$)")
    return F.contains(lowered, F.lit(key))


def keyword_count(c: Column, keywords: Iterable[str]) -> Column:
    """How many of the keywords stand in a text."""
    lowered = F.lower(blank_if_null(c))
    out = F.lit(0)
    for k in keywords:
        out = out + keyword_hit(lowered, k).cast("int")
    return out


@cache
def _spellings() -> dict[str, str]:
    """Characters that are one letter but for their case, by folded form: `s` has the long s too, and the Turkish i's stand alone."""
    out: dict[str, str] = {}
    for c in map(chr, range(0x110000)):
        out[c.casefold()] = out.get(c.casefold(), "") + c
    return out


def alias_pattern(alias: str) -> str:
    """A pattern for an alias in any case, accented letters too, between characters that are neither letters nor digits of the English alphabet in any spelling."""
    same = lambda c: s if len(s := _spellings()[c.casefold()]) > 1 else c
    letters = "".join(f"[{''.join(map(re.escape, same(c)))}]" for c in alias)
    border = "A-Za-z0-9" + _spellings()["s"] + _spellings()["k"]
    return rf"(^|[^{border}]){letters}([^{border}]|$)"


def plain_html(c: Column) -> Column:
    """Text of a page: scripts, styles and tags go, common entities are decoded, page furniture lines go, blank lines collapse."""
    text = F.regexp_replace(blank_if_null(c), r"(?is)<script.*?</script>|<style.*?</style>", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, "\r\n?", "\n")
    lines = F.transform(F.split(text, "\n"), lambda line: F.trim(F.regexp_replace(line, r"[ \t\f\x0B]+", " ")))
    furniture = "(?i)" + "|".join(BOILERPLATE_LINES)
    kept = F.array_join(F.filter(lines, lambda line: ~line.rlike(furniture)), "\n")
    return F.regexp_replace(F.regexp_replace(kept, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def source_of(url: Column) -> Column:
    """Host of a web address without www; empty if it has none."""
    return F.lower(F.regexp_extract(blank_if_null(url), r"https?://(?:www\.)?([^/]+)", 1))


def safe_id(c: Column) -> Column:
    """Letters and digits with underscores between; UNKNOWN if nothing is left."""
    part = F.regexp_replace(F.regexp_replace(blank_if_null(c), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(part == "", "UNKNOWN").otherwise(part)


def lead(c: Column, n: int = 2) -> Column:
    """The first n paragraphs, or sentences if there are fewer paragraphs."""
    paragraphs = F.filter(F.transform(F.split(blank_if_null(c), r"\n\s*\n"), lambda p: one_spaced(p)), lambda p: p != "")
    chosen = F.when(F.size(paragraphs) >= n, paragraphs).otherwise(sentences(c))
    return F.array_join(F.slice(chosen, 1, n), " ")


def packed(parts: Column, size: int) -> Column:
    """Joins parts in order into paragraphs, each closed once it has `size` characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state, part):
        grown = F.when(state["open"] == "", part).otherwise(F.concat(state["open"], F.lit(" "), part))
        full = F.length(grown) >= size
        return F.struct(F.when(full, F.concat(state["done"], F.array(grown))).otherwise(state["done"]).alias("done"), F.when(full, F.lit("")).otherwise(grown).alias("open"))

    return F.aggregate(parts, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
