"""Tolerant reading of JSON that models write, and checks of what it holds.

Well-formed objects are recognised by a built-in function; only other texts go to
Python, in batches. There a text is cut into tokens once; what is odd about them is
noted as defects, the tokens of the largest object are written out in their proper
form, and a table says what the defects are called and what helps.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "ok boolean, payload string, failure_type string, recommended_fix string"

# Defects of a text that was read, most telling first, with their label and remedy.
DEFECTS = {
    "stray comma": ("missing_comma_or_brace", "repair_json"),
    "bad escape": ("missing_comma_or_brace", "repair_json"),
    "other literal": ("invalid_escape_or_quote", "repair_json"),
    "fence": ("markdown_wrapped_json", "strip_markdown_and_parse"),
    "thoughts": ("think_block_before_json", "strip_think_block_and_parse"),
    "several objects": ("multiple_json_objects", "extract_largest_json_object"),
    "words around": ("leading_or_trailing_text", "extract_largest_json_object"),
}
# Defects of a text that could not be read.
FATAL = {
    "nothing": ("empty_response", "rescore_dimensionwise"),
    "left open": ("truncated_json", "repair_json"),
    "bad escape": ("invalid_escape_or_quote", "repair_json"),
    "other literal": ("invalid_escape_or_quote", "repair_json"),
    "gave up": ("timeout_or_no_response", "rescore_dimensionwise"),
    "no object": ("not_json", "rescore_dimensionwise"),
    "too deep": ("nested_too_deeply", "rescore_dimensionwise"),
    "unknown": ("missing_comma_or_brace", "repair_json"),
}
_LITERALS = {"True": "true", "False": "false", "None": "null"}
_TOKEN = re.compile(r"""(?P<thoughts><think\b[^>]*>.*?</think>)|(?P<fence>```(?:json)?)|(?P<string>"(?:[^"\\]|\\.)*")|(?P<single>'(?:[^'\\]|\\.)*')|(?P<mark>[{}\[\],:])|(?P<space>\s+)|(?P<word>[\w.+-]+)|(?P<other>.)""", re.S | re.I)


class Token(NamedTuple):
    kind: str
    text: str


def tokens(text: str) -> list[Token]:
    """All of a text in tokens: strings are whole, so that what they hold is no structure."""
    return [Token(m.lastgroup, m[0]) for m in _TOKEN.finditer(text)]


def spans(found: list[Token]) -> tuple[list[tuple[int, int]], int]:
    """Token ranges of the outermost balanced objects, and how many braces are left open."""
    out, opened = [], []
    for i, t in enumerate(found):
        if t == ("mark", "{"):
            opened.append(i)
        elif t == ("mark", "}") and opened:
            start = opened.pop()
            out = [*(s for s in out if s[0] < start), (start, i + 1)]
    return out, len(opened)


def _proper(found: list[Token], defects: set[str]) -> str:
    """Tokens of an object in the form that JSON has for them; what had to be changed joins `defects`."""
    solid = [t for t in found if t.kind != "space"]
    out = []
    for t, following in zip(solid, [*solid[1:], Token("mark", "")], strict=True):
        if t == ("mark", ",") and following.text in ("}", "]"):
            defects.add("stray comma")
        elif t.kind == "single":
            defects.add("other literal")
            out.append(json.dumps(re.sub(r"\\(.)", r"\1", t.text[1:-1]), ensure_ascii=False))
        elif t.kind == "word" and t.text in _LITERALS:
            defects.add("other literal")
            out.append(_LITERALS[t.text])
        elif t.kind == "string":
            fixed = re.sub(r'\\(["\\/bfnrtu]|)', lambda m: m[0] if m[1] else "\\\\", t.text)
            if fixed != t.text:
                defects.add("bad escape")
            out.append(fixed)
        else:
            out.append(t.text)
    return "".join(out)


def read(raw: str | None) -> tuple[bool, str | None, str, str]:
    """(ok, payload as JSON, what was wrong, what helps). An intact text has nothing wrong; one nested deeper than Python reads cannot be read."""
    text, defects = (raw or "").strip(), set()
    if not text:
        return False, None, *FATAL["nothing"]
    written = lambda value: json.dumps(value, sort_keys=True, ensure_ascii=False)
    try:
        return True, written(json.loads(text)), "", ""
    except RecursionError:
        return False, None, *FATAL["too deep"]
    except ValueError:
        pass
    found = tokens(text)
    objects, left_open = spans(found)
    if objects:
        begin, end = max(objects, key=lambda s: sum(len(t.text) for t in found[s[0] : s[1]]))
        around = found[:begin] + found[end:]
        kinds = {t.kind for t in around}
        defects |= {k for k in ("fence", "thoughts") if k in kinds}
        if "</think>" in "".join(t.text for t in around if t.kind != "thoughts").lower():
            defects.add("thoughts")
        if len(objects) > 1:
            defects.add("several objects")
        if kinds & {"word", "other", "string"}:
            defects.add("words around")
        try:
            value = json.loads(_proper(found[begin:end], defects))
            return True, written(value), *next(DEFECTS[d] for d in DEFECTS if d in defects)
        except RecursionError:
            return False, None, *FATAL["too deep"]
        except (ValueError, StopIteration):
            pass
    if left_open:
        return False, None, *FATAL["left open"]
    if any(t.kind == "string" and re.search(r'\\(?!["\\/bfnrtu])', t.text) for t in found):
        return False, None, *FATAL["bad escape"]
    if any(t.kind == "single" for t in found) and objects:
        return False, None, *FATAL["other literal"]
    if "{" not in text:
        return False, None, *FATAL["gave up" if re.search("timeout|timed out", text, re.I) else "no object"]
    return False, None, *FATAL["unknown"]


def _repaired(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read(t) for t in raw], columns=["ok", "payload", "failure_type", "recommended_fix"])


def stabilized(df: DataFrame, raw: str) -> DataFrame:
    """Adds ok, payload, failure_type and recommended_fix. Intact texts are found by a built-in parse and never leave the JVM."""
    # the built-in parse passes over what follows a value; inside both kinds of brackets nothing can follow
    intact = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x": '), raw, F.lit("}"))).isNotNull()
    intact = intact & (F.trim(F.coalesce(F.col(raw), F.lit(""))) != "")
    marked = df.withColumn("intact_", F.coalesce(intact, F.lit(False)))
    good = marked.where("intact_").select(*df.columns, F.lit(True).alias("ok"), F.trim(raw).alias("payload"), F.lit("").alias("failure_type"), F.lit("").alias("recommended_fix"))
    rest = marked.where("not intact_").withColumn("r_", F.pandas_udf(_repaired, RESULT)(F.col(raw))).select(*df.columns, "r_.*")
    return good.unionByName(rest)


def payload_issues(payload: Column, *, longest_reason: int = 240) -> Column:
    """Sorted issues of a one-dimension payload: score 1..5, evidence a locator, reason not too long, nothing nested."""
    at = lambda k: F.get_json_object(payload, f"$.{k}")
    score, evidence, reason = at("score"), at("evidence"), at("reason")
    nested = F.coalesce(payload.rlike(r":\s*[\[{]"), F.lit(False))
    return F.array_sort(
        F.array_compact(
            F.array(
                F.when(score.isNull(), "missing_score").when(~F.coalesce(score.try_cast("int").between(1, 5) & score.rlike(r"^\d+$"), F.lit(False)), "score_out_of_range"),
                F.when(F.coalesce(evidence, F.lit("")) == "", "missing_evidence").when(~evidence.rlike(r"^\[?(MDA_P\d{3}|NEWS_P\d{3}|TITLE|LEAD)\]?$"), "evidence_not_a_locator"),
                F.when(F.coalesce(reason, F.lit("")) == "", "missing_reason").when(F.length(reason) > longest_reason, "reason_too_long"),
                F.when(nested, "nested_value"),
            )
        )
    )


def probed(payload: Column, paths: list[str]) -> Column:
    """The value at the first of several paths that has one."""
    return F.coalesce(*[F.get_json_object(payload, p) for p in paths])
