"""Scoring by an injected model call: budget, call, repair, validate, retry, and a status for every task.

Attempts are rounds over the tasks that are still open. A round's answers are written
to the shared folder before they are judged, so that a lost executor repeats the calls
of its own tasks at most, and judging and retrying never call again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.text import blank_if_null, token_estimate
from scorewright.operators.jsonfix import stabilized
from scorewright.sources.tables import keeper, short_batches

# Fields of an answer, the longest reason, and what a retry adds to the prompt.
FIELDS = ("evidence", "reason", "score")
LONGEST_REASON = 240
RETRY = "\n\nRetry: return exactly one JSON object with only score, evidence, reason."
CONTEXT, ANSWER, MARGIN, SEEN_SHARE = 4096, 192, 128, 0.90
#: Answer of a call: its text, and how many tokens of the prompt the model says it saw (null: it does not say).
Call = Callable[[str, int], "str | tuple[str, int | None]"]
ANSWERED = "raw string, seen long, failed string"


def answer_issues(payload: Column, text: Column, prefix: Column) -> Column:
    """Sorted distinct issues of an answer about one dimension: its fields, a whole score from 1 to 5, a locator (<prefix>_P###) that the text has, a short reason without arithmetic."""
    fields = F.map_entries(F.from_json(payload, "map<string,variant>"))
    keys = F.transform(fields, lambda e: e["key"])
    nested = F.filter(fields, lambda e: F.schema_of_variant(e["value"]).rlike("^(OBJECT|ARRAY)"))
    evidence = _locator(payload, prefix)
    reason = spaced_reason(payload)
    score = whole_score(payload)
    named = lambda what, names: F.transform(names, lambda n: F.concat(F.lit(what), n))
    rules = F.array(
        F.when(score.isNull(), "score_not_integer"),
        F.when(~F.coalesce(score.between(1, 5), F.lit(False)), "score_out_of_range"),
        F.when(evidence == "", "empty_evidence").when(~F.contains(blank_if_null(text), F.concat(F.lit("["), evidence, F.lit("]"))), "evidence_locator_not_found"),
        F.when(reason == "", "empty_reason").when(F.length(reason) > LONGEST_REASON, "reason_too_long"),
        F.when(reason.rlike(r"\d+\s*[+\-*/]\s*\d+"), "reason_contains_arithmetic"),
    )
    known = F.array(*[F.lit(f) for f in FIELDS])
    issues = F.concat(named("unexpected_field_", F.array_except(keys, known)), named("missing_field_", F.array_except(known, keys)), named("nested_value_", F.transform(nested, lambda e: e["key"])), F.array_compact(rules))
    return F.when(fields.isNull(), F.array(F.lit("payload_not_object"))).otherwise(F.array_sort(F.array_distinct(issues)))


def _said(payload: Column, field: str) -> Column:
    """A field as text; a null one is the word None, a missing one empty."""
    value = F.variant_get(F.try_parse_json(payload), f"$.{field}", "variant")
    return F.when(F.is_variant_null(value), "None").otherwise(blank_if_null(F.get_json_object(payload, f"$.{field}")))


def _locator(payload: Column, prefix: Column) -> Column:
    """The first locator with the prefix that the evidence names, or empty."""
    return F.coalesce(F.regexp_substr(_said(payload, "evidence"), F.concat(prefix, F.lit(r"_P\d{3}"))), F.lit(""))


def whole_score(payload: Column) -> Column:
    """The score as a whole number: fractions of numbers are cut, texts must be whole numbers; else null."""
    said = F.get_json_object(payload, "$.score")
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(payload), "$.score", "variant"))
    number, whole = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), (kind == "STRING") & said.rlike(r"^\s*[+-]?\d+\s*$")
    x = F.greatest(F.lit(-1e9), F.least(F.lit(1e9), F.trim(said).try_cast("double")))
    cut = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("int")
    return F.when(number | whole, cut).when(kind == "BOOLEAN", (said == "true").cast("int"))


def spaced_reason(payload: Column) -> Column:
    return F.trim(F.regexp_replace(_said(payload, "reason"), r"(?U)\s+", " "))


def seen_limit(context: int = CONTEXT, answer: int = ANSWER, share: float = SEEN_SHARE) -> int:
    """Prompt tokens from which a model has read too much to answer in its context."""
    return min(context - answer, math.floor(context * share))


def scored(tasks: DataFrame, call: Call, *, id_cols: list[str], prompt: str = "prompt", text: str = "text", prefix: str = "prefix", attempts: int = 3, budget: int = CONTEXT - ANSWER - MARGIN, most_seen: int | None = None) -> DataFrame:
    """id_cols, status, score, evidence, reason, attempts, parse_status, schema_status, error_type, error_message: one row for each task.

    `call(prompt, attempt)` returns the model's answer, or that and the prompt tokens it
    saw; it may raise. A task whose prompt is estimated over `budget` tokens is not
    called (context_budget_failed). An answer is repaired, then validated against the text
    (locators begin with the task's prefix); a valid one ends the task. Otherwise it is called again, with
    a reminder, `attempts` times in all. With `most_seen`, an answer whose prompt reached
    so many tokens, or that does not say, ends the task (prompt_eval_too_high). A call
    that raises counts as an attempt, and leaves its mark: such a task is `failed`
    (request_failed) even if a later attempt is valid, and is to be run again. What never
    became valid is manual_required, with the last issues. Null prompts and texts are empty.
    id_cols tell tasks apart; a task that repeats is called for each of its rows.
    """
    keep = keeper(tasks.sparkSession, "scorer")
    rows = keep(tasks.select(*id_cols, blank_if_null(F.col(prompt)).alias("prompt_"), blank_if_null(F.col(text)).alias("text_"), F.col(prefix).alias("prefix_")).withColumn("tokens_", token_estimate(F.col("prompt_"))))
    none = F.lit(None).cast("string")
    over = rows.where(F.col("tokens_") > budget)
    done = [_told(over, id_cols, "context_budget_failed", F.concat(F.lit("tokens "), F.col("tokens_").cast("string"), F.lit(" over "), F.lit(str(budget))), attempts=F.lit(0), parse=F.lit("not_attempted"))]
    open_ = rows.where(F.col("tokens_") <= budget).withColumn("request_", none)
    for attempt in range(1, attempts + 1):
        # Python gets the prompts alone; the other columns wait in the JVM
        asked = open_.withColumn("told_", _caller(call, attempt)(F.concat("prompt_", F.lit(RETRY if attempt > 1 else ""))))
        with short_batches(tasks.sparkSession):
            answers = keep(asked.select(*open_.columns, "told_.*"))
        answers = answers.withColumn("request_", F.coalesce("failed", "request_"))
        blind = F.lit(False) if most_seen is None else F.col("failed").isNull() & ~F.coalesce(F.col("seen") < most_seen, F.lit(False))
        done.append(_told(answers.where(blind), id_cols, "prompt_eval_too_high", F.concat(F.lit("prompt tokens "), F.coalesce(F.col("seen").cast("string"), F.lit("unknown"))), attempts=F.lit(attempt), parse=F.lit("not_attempted")))
        read = stabilized(answers.where(F.col("failed").isNull() & ~blind), "raw")
        object_ = F.col("ok") & F.ltrim(F.col("payload")).startswith("{")
        issues = F.when(object_, answer_issues(F.col("payload"), F.col("text_"), F.col("prefix_"))).otherwise(F.array(F.lit("json_parse_failed")))
        judged = keep(read.withColumn("issues_", issues).withColumn("parse_", F.when(F.col("ok"), "parsed").otherwise("parse_failed")))
        good = F.size("issues_") == 0
        done.append(_valid(judged.where(good), id_cols, attempt))
        left = judged.where(~good).select(*open_.columns, "parse_", F.array_join("issues_", ";").alias("last_"))
        left = left.unionByName(answers.where(F.col("failed").isNotNull()).select(*open_.columns, F.lit("not_attempted").alias("parse_"), F.col("failed").alias("last_")))
        open_ = left.select(*open_.columns)
    failed = F.col("request_").isNotNull()
    done.append(_told(left, id_cols, F.when(failed, "request_failed").otherwise("manual_required"), F.coalesce("request_", "last_"), attempts=F.lit(attempts), parse=F.col("parse_")))
    return reduce(DataFrame.unionByName, done)


def _caller(call: Call, attempt: int):
    """The call as a function of a column of prompts, made once for each row."""

    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told = [_answer(call, p, attempt) for p in b]
            yield pd.DataFrame({n: pd.Series([t[i] for t in told], index=b.index, dtype=kind) for i, (n, kind) in enumerate((("raw", object), ("seen", "Int64"), ("failed", object)))})

    return F.pandas_udf(ask, ANSWERED).asNondeterministic()


def _answer(call: Call, prompt: str, attempt: int) -> tuple[str | None, int | None, str | None]:
    """(answer, prompt tokens seen, error): one task's failure is its own."""
    try:
        out = call(prompt, attempt)
    except Exception as e:  # noqa: BLE001 - whatever the service raises is the task's status
        return None, None, str(e) or type(e).__name__
    return (out, None, None) if isinstance(out, str) else (out[0], out[1], None)


def _told(rows: DataFrame, id_cols: list[str], error: str | Column, message: Column, *, attempts: Column, parse: Column) -> DataFrame:
    none = F.lit(None)
    error = F.lit(error) if isinstance(error, str) else error
    return rows.select(*id_cols, F.lit("failed").alias("status"), none.cast("int").alias("score"), none.cast("string").alias("evidence"), none.cast("string").alias("reason"), attempts.cast("int").alias("attempts"), parse.alias("parse_status"), F.lit("invalid").alias("schema_status"), error.alias("error_type"), message.alias("error_message"))


def _valid(rows: DataFrame, id_cols: list[str], attempt: int) -> DataFrame:
    """Tasks with a valid answer; those with a failed request before it are failed all the same."""
    p, clean = F.col("payload"), F.col("request_").isNull()
    shown = lambda c: F.when(clean, c)
    return rows.select(*id_cols, F.when(clean, "success").otherwise("failed").alias("status"), shown(whole_score(p)).alias("score"), shown(_locator(p, F.col("prefix_"))).alias("evidence"), shown(spaced_reason(p)).alias("reason"), F.lit(attempt).alias("attempts"), F.col("parse_").alias("parse_status"), F.lit("valid").alias("schema_status"), F.when(clean, "").otherwise("request_failed").alias("error_type"), F.coalesce("request_", F.lit("")).alias("error_message"))
